"""Queries over documents, labels and conversations as samples of a dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curaspark.functions import text as T
from curaspark.functions.signal import hash_similarity
from curaspark.operators import cache, duplicates, splits, summary, validation
from curaspark.plans import exports


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def discrete_distribution(spark, sf_dir):
    return summary.distribution(table(spark, sf_dir, "documents"), "lang").select("lang", "count", "percent")


def source_distribution(spark, sf_dir):
    return summary.distribution(table(spark, sf_dir, "documents"), "source", "lang").select("source", "lang", "count", "percent")


SIZES = [0, 100, 500, 1000, 5000, 10000, 50000]


def size_histogram(spark, sf_dir):
    return summary.histogram(table(spark, sf_dir, "documents"), "n_chars", SIZES)


def value_histogram(spark, sf_dir):
    return summary.histogram(table(spark, sf_dir, "events"), "value", [0.01, 50.0, 100.0, 250.0, 490.02])


def equal_width(spark, sf_dir):
    held = summary.equal_width_histogram(table(spark, sf_dir, "events"), "value", 20)
    return held.select("bucket", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "count")


def distinct_hashes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("hash", F.sha2("text", 256))
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("total"), F.count_distinct("hash").alias("unique_hashes"))


def exact_duplicates(spark, sf_dir):
    return duplicates.exact_groups(table(spark, sf_dir, "documents"), F.col("text"), "doc_id")


def prompt_jaccard(spark, sf_dir):
    """Similar turns of conversations, by the sets of their words."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), T.tokens(F.col("text")).alias("words"))
    return duplicates.all_jaccard_pairs(turns, "id", "words", 0.15).select("a", "b", F.round("similarity", 4).alias("similarity"))


def hash_bit_similarity(spark, sf_dir):
    """Each document's hash against the next one's: a join on neighbouring ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    following = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("h").alias("g"))
    return docs.join(following, "doc_id").select("doc_id", F.round(hash_similarity(F.col("h"), F.col("g")), 6).alias("similarity"))


PAIRS = "lead(text) OVER (PARTITION BY conv_id ORDER BY turn)"


def word_error_rate(spark, sf_dir):
    """A turn against the next one of its conversation."""
    turns = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "text", f"{PAIRS} AS heard").where("heard IS NOT NULL")
    held = turns.select("conv_id", "turn", T.tokens(F.col("text")).alias("r"), T.tokens(F.col("heard")).alias("h"))
    rate = T.word_error_rate(F.col("r"), F.col("h"))
    return held.select("conv_id", "turn", F.size("r").cast("long").alias("n_reference"), F.size("h").cast("long").alias("n_heard"), F.round(rate, 6).alias("wer"))


def asr_acceptance(spark, sf_dir):
    held = word_error_rate(spark, sf_dir).withColumn("confidence", T.confidence(F.array(-F.col("n_heard") / 100.0, F.col("n_heard") / 50.0)))
    wer, confidence = F.col("wer"), F.col("confidence")
    return held.select("conv_id", "turn", validation.accepted(wer, confidence, 0.9, 0.55).alias("accepted"), validation.acceptance_error(wer, confidence, 0.9, 0.55).alias("error"))


def shuffle_split(spark, sf_dir):
    held = splits.shuffle_split(table(spark, sf_dir, "labels"), "doc_id", (0.8, 0.1, 0.1), ["quality"])
    return held.select("doc_id", "quality", "split")


def stratified_split(spark, sf_dir):
    return splits.stratified_split(table(spark, sf_dir, "labels"), "doc_id", "toxic", (0.7, 0.2, 0.1)).select("doc_id", "toxic", "split")


def split_counts(spark, sf_dir):
    return summary.split_counts(shuffle_split(spark, sf_dir), "split", "quality")


def samples(spark, sf_dir):
    held = splits.stratified_split(table(spark, sf_dir, "labels"), "doc_id", "quality")
    return held.select(F.col("doc_id").alias("sample_id"), F.format_string("clips/%d.wav", "doc_id").alias("path"), F.col("quality").alias("label"), "split")


def labelled_union(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("documents").alias("origin"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lit("benchmark").alias("origin"))
    return exports.labelled_union(items, docs, "hey you")


def positive_numbering(spark, sf_dir):
    return exports.numbered(samples(spark, sf_dir), "sample_id", "label").select("sample_id", "label", "number", "export_name")


def export_metadata(spark, sf_dir):
    return exports.metadata(samples(spark, sf_dir))


def scored_labels(spark, sf_dir):
    """Toxicity said by two rules of thumb: the length of the text, and its number of lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.size(F.split("text", "\n")).alias("n_lines"))
    held = table(spark, sf_dir, "labels").join(docs, "doc_id").where("toxic is not null")
    models = F.array(F.struct(F.lit("length").alias("model"), (F.col("n_chars") < 1500).alias("said")), F.struct(F.lit("lines").alias("model"), (F.col("n_lines") < 8).alias("said")))
    return held.select("doc_id", (F.col("toxic") == 1).alias("real"), F.inline(models))


def confusion_metrics(spark, sf_dir):
    held = summary.confusion(scored_labels(spark, sf_dir), "real", "said", "model")
    return held.select("model", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


def ab_comparison(spark, sf_dir):
    held = summary.compare_models(summary.confusion(scored_labels(spark, sf_dir), "real", "said", "model"), "length", "lines")
    return held.select(F.round("accuracy_gain", 6).alias("accuracy_gain"), F.round("f1_gain", 6).alias("f1_gain"), "winner")


def detector_scores(spark, sf_dir):
    """The best frame of each user's events as frame scores."""
    frames = table(spark, sf_dir, "events").select("user_id", (F.col("value") / 500).alias("score"))
    return summary.best_frame_scores(frames, "user_id").select("user_id", F.round("score", 6).alias("score"))


def content_cache_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", cache.content_key(F.col("text"), F.col("lang"), F.col("source")).alias("cache_key"))


def emphasis_variants(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.explode(F.array(F.lit(0), F.lit(1), F.lit(5))).alias("position"))
    return parts.select("p_partkey", "position", T.emphasised(F.col("p_name"), F.col("position")).alias("variant"))


def phrase_templates(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(T.phrases(F.col("p_name"))).alias("pattern", "phrase"))


def name_rules(spark, sf_dir):
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", T.slug(name).alias("slug"), T.dashed(name).alias("dashed"), T.truncated(F.concat(name, F.lit(" "), F.col("p_type"), F.lit(" "), F.col("p_brand")), 20).alias("short"))


def path_parts(spark, sf_dir):
    p = T.path_parts(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", p["name"].alias("name"), p["suffix"].alias("suffix"), p["parent"].alias("parent"))


def json_params(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


RANK = "row_number() OVER (PARTITION BY {0} ORDER BY md5('42:' || doc_id::VARCHAR), doc_id) - 1"
SHUFFLED = f"""s AS (SELECT doc_id, quality, {RANK.format('quality')} AS r, count(*) OVER (PARTITION BY quality) AS n FROM labels),
t AS (SELECT doc_id, quality, CASE WHEN r < floor(n * 0.8::DOUBLE) THEN 'train' WHEN r < floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM s)"""


def _stratified(label: str, val: float, test: float) -> str:
    rest = f"ceil(round((n - ceil(round(n * {test}::DOUBLE, 9))) * {val}::DOUBLE, 9))"
    return f"""s AS (SELECT doc_id, {label}, {RANK.format(label)} AS r, count(*) OVER (PARTITION BY {label}) AS n FROM labels),
t AS (SELECT doc_id, {label}, CASE WHEN r < ceil(round(n * {test}::DOUBLE, 9)) THEN 'test' WHEN r < ceil(round(n * {test}::DOUBLE, 9)) + {rest} THEN 'val' ELSE 'train' END AS split FROM s)"""


SAMPLES = _stratified("quality", 0.1 / 0.9, 0.1)
PREDICTED = """p AS (SELECT l.toxic = 1 AS re, n_chars < 1500 AS a, len(string_split(text, chr(10))) < 8 AS b FROM labels l JOIN documents d USING (doc_id)),
u AS (SELECT 'length' AS model, re, a AS said FROM p UNION ALL SELECT 'lines', re, b FROM p),
k AS (SELECT model, count(*) FILTER (re AND said) AS tp, count(*) FILTER (NOT re AND said) AS fp, count(*) FILTER (re AND NOT said) AS fn, count(*) FILTER (NOT re AND NOT said) AS tn FROM u GROUP BY model),
x AS (SELECT *, (tp + tn) / (tp + fp + fn + tn) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM k)"""
TOKENS = r"list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')"


def _histogram_sql(source: str, value: str, edges: list) -> str:
    rows = []
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        less = "<=" if i == len(edges) - 2 else "<"
        rows.append(f"SELECT {i} AS bucket, '{lo}-{hi}' AS label, count(*) FILTER ({value} >= {lo} AND {value} {less} {hi})::BIGINT AS count FROM {source}")
    return " UNION ALL ".join(rows)


SQL = {
    "discrete_distribution": "SELECT lang, count(*)::BIGINT AS count, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 1) AS percent FROM documents GROUP BY lang",
    "source_distribution": "SELECT source, lang, count(*)::BIGINT AS count, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 1) AS percent FROM documents GROUP BY source, lang",
    "size_histogram": _histogram_sql("documents", "n_chars", SIZES),
    "value_histogram": _histogram_sql("events", "value", [0.01, 50.0, 100.0, 250.0, 490.02]),
    "equal_width": """WITH b AS (SELECT min(value) AS lo, (max(value) - min(value)) / 20 AS w FROM events)
SELECT least(floor((value - lo) / w), 19)::INT AS bucket, round(any_value(lo + least(floor((value - lo) / w), 19) * w), 6) AS low, round(any_value(lo + (least(floor((value - lo) / w), 19) + 1) * w), 6) AS high, count(*)::BIGINT AS count FROM events, b GROUP BY 1""",
    "distinct_hashes": "SELECT lang, count(*)::BIGINT AS total, count(DISTINCT sha256(text))::BIGINT AS unique_hashes FROM documents GROUP BY lang",
    "exact_duplicates": "SELECT sha256(text) AS hash, min(doc_id) AS first_id, count(*)::BIGINT AS copies FROM documents GROUP BY 1 HAVING count(*) > 1",
    "prompt_jaccard": f"""WITH s AS (SELECT conv_id * 100 + turn AS id, list_distinct({TOKENS}) AS w FROM conversations), e AS (SELECT id, len(w) AS n, unnest(w) AS w FROM s),
p AS (SELECT x.id AS a, y.id AS b, count(*) AS k, any_value(x.n) AS m, any_value(y.n) AS n FROM e x JOIN e y ON x.w = y.w AND x.id < y.id GROUP BY 1, 2)
SELECT a, b, round(k / (m + n - k), 4) AS similarity FROM p WHERE k / (m + n - k) >= 0.15""",
    "hash_bit_similarity": "WITH d AS (SELECT doc_id, sha256(text) AS h FROM documents) SELECT a.doc_id, round((256 - ("
    + " + ".join(f"bit_count(xor(('0x' || substring(a.h, {8 * i + 1}, 8))::BIGINT, ('0x' || substring(b.h, {8 * i + 1}, 8))::BIGINT))::BIGINT" for i in range(8))
    + ")) / 256, 6) AS similarity FROM d a JOIN d b ON b.doc_id = a.doc_id + 1",
    "shuffle_split": f"WITH {SHUFFLED} SELECT doc_id, quality, split FROM t",
    "stratified_split": f"WITH {_stratified('toxic', 0.2 / (0.7 + 0.2), 0.1)} SELECT doc_id, toxic, split FROM t",
    "split_counts": f"WITH {SHUFFLED} SELECT split, quality, count(*)::BIGINT AS count FROM t GROUP BY ROLLUP (split, quality)",
    "labelled_union": "SELECT item_id AS id, 'benchmark' AS origin, 1 AS label, 'hey you' AS transcript FROM benchmark UNION ALL SELECT doc_id, 'documents', 0, 'unknown' FROM documents",
    "positive_numbering": "WITH n AS (SELECT doc_id AS sample_id, quality AS label, row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1 AS number FROM labels) SELECT *, (CASE WHEN label = 1 THEN 'positive' ELSE 'negative' END) || printf('_%05d.wav', number) AS export_name FROM n",
    "export_metadata": f"WITH {SAMPLES} SELECT split, quality AS label, count(*)::BIGINT AS count FROM t GROUP BY ROLLUP (split, quality)",
    "confusion_metrics": f"WITH {PREDICTED} SELECT model, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM x",
    "ab_comparison": f"""WITH {PREDICTED} SELECT round(b.accuracy - a.accuracy, 6) AS accuracy_gain, round(b.f1 - a.f1, 6) AS f1_gain, CASE WHEN b.f1 > a.f1 THEN 'lines' WHEN b.f1 < a.f1 THEN 'length' ELSE 'tie' END AS winner
FROM x a, x b WHERE a.model = 'length' AND b.model = 'lines'""",
    "detector_scores": "SELECT user_id, round(greatest(0.0, max(value / 500)), 6) AS score FROM events GROUP BY user_id",
    "content_cache_key": "SELECT doc_id, substring(sha256(concat_ws('|', lower(trim(text)), lang, source)), 1, 16) AS cache_key FROM documents",
    "emphasis_variants": """SELECT p_partkey, position, CASE WHEN position < len(string_split(p_name, ' ')) THEN
  array_to_string(list_transform(string_split(p_name, ' '), lambda w, i: CASE WHEN i - 1 = position THEN '*' || w || '*' ELSE w END), ' ') ELSE p_name END AS variant FROM part, (SELECT unnest([0, 1, 5]) AS position)""",
    "phrase_templates": "SELECT p_partkey, (i - 1)::INT AS pattern, replace(ps[i], '{}', p_name) AS phrase FROM part, (SELECT ["
    + ", ".join(f"'{p}'" for p in T.PATTERNS + T.INFORMAL)
    + f"] AS ps), range(1, {len(T.PATTERNS + T.INFORMAL) + 1}) r(i)",
    "name_rules": """SELECT p_partkey, lower(replace(p_name, ' ', '_')) AS slug, translate(lower(p_name), '_ ', '--') AS dashed,
  CASE WHEN length(p_name || ' ' || p_type || ' ' || p_brand) > 20 THEN substring(p_name || ' ' || p_type || ' ' || p_brand, 1, 17) || '...' ELSE p_name || ' ' || p_type || ' ' || p_brand END AS short FROM part""",
    "path_parts": r"SELECT page_id, regexp_extract(url, '[^/]*$') AS name, lower(regexp_extract(regexp_extract(url, '[^/]*$'), '(\.[^.]*)$', 1)) AS suffix, regexp_replace(url, '/?[^/]*$', '') AS parent FROM pages",
    "json_params": "SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM events",
}
QUERIES = {
    k: globals()[k]
    for k in (*SQL, "word_error_rate", "asr_acceptance")
}
