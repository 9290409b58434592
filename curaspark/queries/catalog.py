"""Queries over presets, catalogs and parameter grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from curaspark.operators import presets, splits, summary, validation
from curaspark.queries.dataset import table
from curaspark.sources import registry
from curaspark.sources.registry import filter_voices


def _dealt(rows, key: str, names: list[str], name: str):
    """rows with one of the names each, by their key."""
    return rows.withColumn(name, F.array(*map(F.lit, names))[(F.col(key) % len(names)).cast("int")])


def _devices(spark, sf_dir):
    """Suppliers as devices in the field: each has one of the known kinds."""
    return _dealt(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey", [d[0] for d in presets.DEVICES], "device")


def device_presets_join(spark, sf_dir):
    held = presets.device_parameters(presets.devices(spark), presets.reverb_levels(spark))
    held = presets.lookup_or_fail(_devices(spark, sf_dir), held, "device")
    return held.withColumn("priorities", F.array_join("priorities", ","))


def device_priorities(spark, sf_dir):
    held = _devices(spark, sf_dir).join(F.broadcast(presets.devices(spark)), "device")  # sixteen kinds
    return held.select(F.explode(presets.priorities()).alias("step")).groupBy("step").agg(F.count(F.lit(1)).alias("devices"))


def preset_star(spark, sf_dir):
    """Every customer's environment with its room and microphone."""
    rows = _dealt(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", [e[0] for e in presets.ENVIRONMENTS], "profile")
    held = rows.join(F.broadcast(presets.environment_star(spark)), "profile")  # six environments
    return held.select("c_custkey", "profile", "noise", "room", "mic", "rt60", "absorption", "distortion", "noise_floor_db", "mic_rate")


def variation_grid(spark, sf_dir):
    axes = {"speed": splits.grid(0.8, 1.2, 3), "pitch": splits.grid(-2.0, 2.0, 3)}
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return splits.cartesian(nations, axes).select("n_nationkey", F.round("speed", 6).alias("speed"), F.round("pitch", 6).alias("pitch"), "ordinal", "combinations")


def variation_prefix(spark, sf_dir):
    """The first 40 combinations in the order of their axes."""
    return variation_grid(spark, sf_dir).orderBy("n_nationkey", "ordinal").limit(40)


def weighted_allocation(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    total = rows.agg(F.sum(F.abs("s_acctbal")).alias("total"))
    held = rows.join(F.broadcast(total)).withColumn("weight", F.abs("s_acctbal") / F.col("total"))  # total is one row
    return splits.allocate(held, 1000, "weight", 1).select("s_suppkey", "allocated")


def equal_allocation(spark, sf_dir):
    held = splits.equal_weights(table(spark, sf_dir, "nation").select("n_nationkey"))
    return splits.allocate(held, 1000).select("n_nationkey", F.round("weight", 6).alias("weight"), "allocated")


def language_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("name"), F.lit("none").alias("gender"), F.col("lang").alias("language"))
    return filter_voices(docs, language=["EN", "r"]).select("id", "name", "language")


def voice_preference(spark, sf_dir):
    """Of each language the voice that is preferred: the largest document, then the smallest id."""
    docs = table(spark, sf_dir, "documents")
    return registry.preferred(docs, "lang", F.lit(True), [-F.col("n_chars"), F.col("doc_id")], ["doc_id", "n_chars"])


def preferred_voices(spark, sf_dir):
    """Of each language the first document from the web, or where there is none the first of all."""
    docs = table(spark, sf_dir, "documents")
    return registry.preferred(docs, "lang", F.col("source").startswith("web"), [F.col("doc_id")], ["doc_id", "source"])


def device_categories(spark, sf_dir):
    """Suppliers as devices: how many of each category, and of those in one of them the rates they sample at."""
    held = _devices(spark, sf_dir).join(F.broadcast(presets.devices(spark)), "device")  # sixteen kinds
    each = held.withColumn("category", presets.category_of(F.col("device"))).groupBy("category").agg(F.count(F.lit(1)).alias("devices"))
    speakers = presets.in_category(held, "smart_speaker").groupBy(F.lit("smart_speaker").alias("category")).agg(F.sum("channels").cast("long").alias("channels"))
    return each.join(speakers, "category", "left").select("category", "devices", F.coalesce("channels", F.lit(0)).alias("channels"))


def profile_variations(spark, sf_dir):
    """Every customer's environment, varied."""
    held = preset_star(spark, sf_dir).withColumn("pitch_steps", F.lit(0.0))
    return presets.varied(held, "c_custkey", 0.8).select("c_custkey", "profile", *[F.round(c, 6).alias(c) for c in presets.VARIATIONS])


def catalog_top50(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").transform(summary.top, 50, F.desc("n_chars"), "doc_id")


def config_violations(spark, sf_dir):
    """Order lines as specifications, against rules on their values."""
    rows = table(spark, sf_dir, "lineitem").withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    rules = {"count": F.col("l_quantity").between(1, 45), "rate": F.col("l_discount") <= 0.08, "tax": F.col("l_tax") > 0.0}
    return presets.rule_violations(rows, "id", rules).select("id", F.array_join("violations", ",").alias("violations"))


def invalid_names(spark, sf_dir):
    """Brands of parts whose first word is no nation's name: names outside the list of valid ones."""
    return validation.unknown_names(table(spark, sf_dir, "part"), F.split("p_name", " ")[0], table(spark, sf_dir, "nation"), F.col("n_name"))


def catalog_rollup(spark, sf_dir):
    """Revenue by region, nation and segment with all subtotals: presets in a star around the facts."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    star = orders.join(customer, orders.o_custkey == customer.c_custkey).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    held = star.rollup("r_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("revenue"))
    return held.select("r_name", "c_mktsegment", "orders", F.round("revenue", 2).alias("revenue"))


def _rows(rows: list[tuple], columns: list[str]) -> str:
    literal = lambda v: f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v)
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") t({', '.join(columns)}))"


def _dealt_sql(rows: list[tuple], columns: list[str], facts: str, key: str) -> str:
    return f"(SELECT {key}, d.* FROM {facts} JOIN (SELECT *, row_number() OVER () - 1 AS _n FROM {_rows(rows, columns)}) d ON {key} % {len(rows)} = _n)"


_DEVICES = _dealt_sql(presets.DEVICES, [c.split()[0] for c in presets.DEVICE_SCHEMA.split(", ")], "supplier", "s_suppkey")
_PRIORITIES = """list_filter(['microphone_simulation', 'noise_mixing', CASE WHEN reverb IN ('medium', 'high') THEN 'room_simulation' END, CASE WHEN far_m > 3 THEN 'distance_simulation' END,
  CASE WHEN device IN ('mobile_ios', 'mobile_android') THEN 'telephony_simulation' END, CASE WHEN device IN ('esp32_pdm', 'low_power') THEN 'degradation' END], lambda x: x IS NOT NULL)"""
_GRID = """g AS (SELECT n_nationkey, round(0.8 + 0.4 * i / 2, 6)::DOUBLE AS speed, round(-2 + 4.0 * j / 2, 6)::DOUBLE AS pitch, (i * 3 + j)::BIGINT AS ordinal, 9::BIGINT AS combinations FROM nation, range(3) i(i), range(3) j(j))"""
SQL = {
    "device_presets_join": f"""SELECT s_suppkey, device, greatest(50, low_hz)::INT AS highpass_hz, least(rate // 2 - 100, high_hz)::INT AS lowpass_hz, noise_floor_db + 10 AS self_noise_db, rt60, room_size, wet,
  CASE WHEN rate <= 8000 OR device = 'low_power' THEN 'voip_low' END AS phone, adc_bits < 16 AS add_quantisation, interference_types > 0 AS add_interference, array_to_string({_PRIORITIES}, ',') AS priorities,
  least(25, 5 + noise_types + CASE WHEN far_m - near_m > 3 THEN 5 ELSE 0 END + CASE WHEN snr_high - snr_low > 20 THEN 5 ELSE 0 END)::INT AS variations
FROM {_DEVICES} d JOIN {_rows(presets.REVERB, ['reverb', 'rt60', 'room_size', 'wet'])} r USING (reverb)""",
    "device_priorities": f"SELECT step, count(*)::BIGINT AS devices FROM (SELECT unnest({_PRIORITIES}) AS step FROM {_DEVICES} d) GROUP BY step",
    "preset_star": f"""SELECT c_custkey, profile, noise, room, mic, rt60, absorption, distortion, noise_floor_db, mic_rate FROM {_dealt_sql(presets.ENVIRONMENTS, ['profile', 'noise', 'snr_low', 'snr_high', 'epm', 'room', 'mic'], 'customer', 'c_custkey')} e
JOIN {_rows(presets.ROOMS, ['room', 'l', 'w', 'h', 'rt60', 'absorption', 'reflections'])} r USING (room) JOIN {_rows(presets.MICROPHONES, ['mic', 'distortion', 'noise_floor_db', 'mic_rate'])} m USING (mic)""",
    "variation_grid": f"WITH {_GRID} SELECT * FROM g",
    "variation_prefix": f"WITH {_GRID} SELECT * FROM g ORDER BY n_nationkey, ordinal LIMIT 40",
    "weighted_allocation": "SELECT s_suppkey, greatest(floor(1000 * abs(s_acctbal) / (SELECT sum(abs(s_acctbal)) FROM supplier)), 1)::BIGINT AS allocated FROM supplier",
    "equal_allocation": "SELECT n_nationkey, round(1.0::DOUBLE / count(*) OVER (), 6) AS weight, floor(1000::DOUBLE / count(*) OVER ())::BIGINT AS allocated FROM nation",
    "language_filter": "SELECT doc_id::VARCHAR AS id, source AS name, lang AS language FROM documents WHERE contains(lower(lang), 'en') OR contains(lower(lang), 'r')",
    "voice_preference": "SELECT lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1",
    "preferred_voices": "SELECT lang, doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY CASE WHEN starts_with(source, 'web') THEN 0 ELSE 1 END, doc_id) AS r FROM documents) WHERE r = 1",
    "device_categories": f"""SELECT category, count(*) AS devices, coalesce(sum(channels) FILTER (category = 'smart_speaker'), 0)::BIGINT AS channels FROM (SELECT d.*, CASE {" ".join(f"WHEN device IN ({', '.join(map(repr, m))}) THEN '{c}'" for c, m in presets.CATEGORIES.items())} END AS category FROM {_DEVICES} d) GROUP BY category""",
    "catalog_top50": "SELECT doc_id, lang, source, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50",
    "config_violations": """SELECT id, array_to_string(v, ',') AS violations FROM (SELECT l_orderkey || '-' || l_linenumber AS id, list_filter([CASE WHEN l_quantity < 1 OR l_quantity > 45 THEN 'count' END, CASE WHEN l_discount > 0.08 THEN 'rate' END,
  CASE WHEN l_tax <= 0 THEN 'tax' END], lambda x: x IS NOT NULL) AS v FROM lineitem) WHERE len(v) > 0""",
    "invalid_names": "SELECT DISTINCT upper(string_split(p_name, ' ')[1]) AS name FROM part WHERE upper(string_split(p_name, ' ')[1]) NOT IN (SELECT upper(n_name) FROM nation)",
    "catalog_rollup": "SELECT r_name, c_mktsegment, count(*)::BIGINT AS orders, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, c_mktsegment)",
}
QUERIES = {k: globals()[k] for k in SQL} | {"profile_variations": profile_variations}
