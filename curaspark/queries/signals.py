"""Queries over signals: the 64 numbers of each row of embeddings stand for a clip at 64 samples a second."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curaspark.functions import signal as S
from curaspark.functions import damage, degrade, microphone, noise, resampling, spectrum, vocoder
from curaspark.operators import duplicates, errors, neighbours, overlay, presets, summary, validation
from curaspark.plans import assessment, augmentation
from curaspark.sources import records, shared

RATE, WINDOW = 64, 16
#: The vectors have a norm of 1, so their peaks and noise floors differ from those of recordings.
CHECKS = validation.ValidationConfig(sample_rate=RATE, max_peak=0.35, min_rms=0.001, min_snr_db=1.0, snr_window=WINDOW)


def load(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select("vec_id", "label", F.lit(RATE).alias("sample_rate"), S.as_signal(F.col("embedding")).alias("samples"))


def _r(c: str | Column, digits: int = 6) -> Column:
    return F.round(c, digits).alias(c) if isinstance(c, str) else F.round(c, digits)


def signal_features(spark, sf_dir):
    held = validation.signal_features(load(spark, sf_dir), F.col("sample_rate"), WINDOW)
    return held.select("vec_id", "label", *[_r(c) for c in ("duration", "peak", "rms", "zcr", "snr_db")])


def validate_signals(spark, sf_dir):
    return validation.validate(load(spark, sf_dir), CHECKS).select("vec_id", "is_valid", "error", _r("peak"), _r("snr_db"))


def dataset_statistics(spark, sf_dir):
    checked = validation.validate(load(spark, sf_dir), CHECKS)
    held = assessment.statistics(checked, "label")
    figures = [f"{c}_{s}" for c in ("duration", "peak", "rms", "zcr", "snr_db") for s in ("mean", "std", "min", "max")]
    return held.select("label", "total", "valid", "invalid", *[_r(c) for c in figures])


def spectral_features(spark, sf_dir):
    held = load(spark, sf_dir).withColumn("m", spectrum.magnitudes(F.col("samples")))
    m = F.col("m")
    return held.select(
        "vec_id",
        _r(S.centroid(m)).alias("centroid"),
        _r(S.centroid_hz(m, F.col("sample_rate"), F.size("samples"))).alias("centroid_hz"),
        _r(S.flatness(m)).alias("flatness"),
        S.rolloff(m).cast("long").alias("rolloff"),
        _r(S.spectral_entropy(m)).alias("entropy"),
    )


def quality_scores(spark, sf_dir):
    held = assessment.assess(load(spark, sf_dir), CHECKS, window=WINDOW)
    return held.select("vec_id", "is_valid", *[_r(f"{k}_score", 5) for k in (*validation.WEIGHTS, "overall")])


def score_histogram(spark, sf_dir):
    held = assessment.assess(load(spark, sf_dir), CHECKS, window=WINDOW).withColumn("score", F.round("overall_score", 5))
    return summary.histogram(held, "score", [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]).select("bucket", "label", "count")


def signal_moments(spark, sf_dir):
    a = F.col("samples")
    return load(spark, sf_dir).select(
        "vec_id", _r(S.mean(a)).alias("mean"), _r(F.sqrt(S.variance(a))).alias("std"), _r(S.skewness(a), 5).alias("skewness"), _r(S.excess_kurtosis(a), 5).alias("kurtosis")
    )


def signal_embedding(spark, sf_dir):
    """The first ten numbers, which are not the padding's."""
    held = load(spark, sf_dir).select("vec_id", F.slice(S.embedding(F.col("samples")), 1, 10).alias("e"))
    return held.select("vec_id", *[_r(F.col("e")[i], 5).alias(f"e{i}") for i in range(10)])


def cosine_duplicates(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    pairs = duplicates.cosine_pairs(rows, "vec_id", "embedding", 0.4)
    return pairs.select("a", "b", _r("similarity", 4))


def near_signals(spark, sf_dir):
    """Pairs of vectors with a cosine of 0.4 or more, by the hyperplane index."""
    _, kinds = neighbours.classes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return neighbours.hyperplane_pairs(kinds, 0.4, bits=6).select("a", "b", _r("similarity", 4))


def clips_and_copies(spark, sf_dir):
    """Every clip, and for every third a copy that is a bit louder, noisier or cut at its end."""
    rows = load(spark, sf_dir)
    copy = F.transform("samples", lambda x, i: x * 1.5 + F.when(F.col("vec_id") % 2 == 0, F.sin(i * 7 + F.col("vec_id")) * 0.01).otherwise(0.0))
    copy = F.when(F.col("vec_id") % 9 == 0, F.concat(F.slice("samples", 1, 56), F.array_repeat(F.lit(0.0), 8))).otherwise(copy)
    copies = rows.where("vec_id % 3 = 0").select((F.col("vec_id") + 100_000).alias("vec_id"), copy.alias("samples"))
    return rows.select("vec_id", "samples").unionByName(copies)


def near_duplicate_clips(spark, sf_dir):
    """Near duplicates among all clips and copies, by three methods in turn."""
    clips = clips_and_copies(spark, sf_dir)
    _, pairs = neighbours.find_duplicates(clips, "vec_id", "samples", F.col("samples"), threshold=0.9, window=WINDOW, hop=WINDOW // 2, bins=9)
    return pairs.select("a", "b", "method_used", _r("similarity", 4))


def record_files(spark, sf_dir):
    """Every vector as a record, in files by split, and read from there."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    split = F.when(F.col("vec_id") % 10 < 8, "train").when(F.col("vec_id") % 10 == 8, "val").otherwise("test")
    clips = rows.select("vec_id", "label", F.col("embedding").alias("audio"), F.concat(F.lit("clip_"), "vec_id").alias("filename"), split.alias("split"))
    folder = shared.new_folder(spark, "records")
    records.write_records(clips.sortWithinPartitions("split", F.desc("label")), folder, "split")
    held = records.read_records(spark, folder, "vec_id bigint, label bigint, audio array<float>, filename string, split string", "split")
    return held.select("vec_id", "label", "filename", "split", F.size("audio").cast("long").alias("n"), _r(S.total(S.as_signal(F.col("audio"))), 5).alias("sum"))


def error_counts(spark, sf_dir):
    """Errors of all clips by kind and stage: some have no samples, some are silent under noise, some fail the checks."""
    rows = load(spark, sf_dir)
    checked = validation.validate(rows, CHECKS).select("vec_id", errors.error(F.col("error"), "QualityAssuranceError", "validate").alias("checked"))
    broken = F.when(F.col("vec_id") % 10 == 3, F.lit(None)).when(F.col("vec_id") % 10 == 4, F.array_repeat(F.lit(0.0), 64)).otherwise(F.col("samples"))
    made = augmentation.augment(rows.withColumn("samples", broken), [("noise", {"snr": (10.0, 20.0)}), ("compress", {})], to_rate=RATE, key="vec_id")
    held = made.select("vec_id", errors.of_augmentation(F.col("augment_error")).alias("made")).join(checked, "vec_id")
    return errors.counts(held.select(errors.first(F.col("made"), F.col("checked")).alias("error")))


def report_table(spark, sf_dir):
    held = assessment.assess(load(spark, sf_dir), CHECKS, window=WINDOW)
    return assessment.report_rows(held, "vec_id", 50)


def _transform(f):
    def query(spark, sf_dir):
        held = load(spark, sf_dir).select("vec_id", f(F.col("samples")).alias("y"))
        return held.select("vec_id", F.size("y").cast("long").alias("n"), _r(S.total(F.col("y")), 5).alias("sum"), _r(S.rms(F.col("y")), 5).alias("rms"), _r(F.col("y")[F.size("y") - 1], 5).alias("last"))

    return query


def snr_mix(spark, sf_dir):
    """Each vector with the one of the next id as noise, 10 dB below."""
    rows = load(spark, sf_dir)
    noise = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("samples").alias("noise"))
    held = rows.join(noise, "vec_id").select("vec_id", S.mix_at_snr(F.col("samples"), F.col("noise"), 10.0).alias("y"))
    return held.select("vec_id", _r(S.total(F.col("y")), 5).alias("sum"), _r(S.rms(F.col("y")), 5).alias("rms"), _r(F.col("y")[63], 5).alias("last"))


def dft_bandpass(spark, sf_dir):
    held = load(spark, sf_dir).select("vec_id", spectrum.band_pass(F.col("samples"), 4, 16, RATE).alias("y"))
    return held.select("vec_id", _r(S.total(F.col("y")), 5).alias("sum"), _r(S.rms(F.col("y")), 5).alias("rms"))


def phone_band(spark, sf_dir):
    held = load(spark, sf_dir).select("vec_id", spectrum.phone_band(F.col("samples"), 4, 16, RATE).alias("y"))
    return held.select("vec_id", _r(S.total(F.col("y")), 5).alias("sum"), _r(S.rms(F.col("y")), 5).alias("rms"))


def packet_loss(spark, sf_dir):
    held = load(spark, sf_dir).select("vec_id", degrade.packet_loss(F.col("samples"), F.col("vec_id"), RATE, 0.3, 125.0).alias("y"))
    return held.select("vec_id", _r(S.rms(F.col("y")), 5).alias("rms"))


def random_events(spark, sf_dir):
    held = load(spark, sf_dir).select("vec_id", F.inline(degrade.random_events(F.col("vec_id"), 60.0, 6.0)))
    return held.select("vec_id", "type", _r("start", 5), _r("duration", 5), _r("strength", 5))


ARRAYS = "s AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS a FROM embeddings)"
FEATURES = """f AS (
  SELECT *, len(a) / 64.0 AS duration, list_max(list_transform(a, lambda x: abs(x))) AS peak,
         sqrt(list_sum(list_transform(a, lambda x: x * x)) / len(a)) AS rms,
         list_sum(list_transform(range(1, len(a)), lambda i: abs(sign(a[i + 1])::DOUBLE - sign(a[i])))) / (2.0 * len(a)) AS zcr,
         10 * log10((list_sum(list_transform(a, lambda x: x * x)) / len(a))
           / list_min(list_transform(range(0, len(a) // 16), lambda k: list_sum(list_transform(a[k * 16 + 1 : k * 16 + 16], lambda x: x * x)) / 16))) AS snr_db
  FROM s)"""
CHECKED = r"""v AS (
  SELECT *, CASE WHEN peak > 0.35 THEN printf('peak amplitude %.3f > 0.35', peak) END AS e1,
         CASE WHEN snr_db < 1.0 THEN printf('SNR %.2fdB < 1.0dB', snr_db) END AS e2 FROM f),
c AS (SELECT *, nullif(concat_ws('; ', e1, e2), '') AS error, e1 IS NULL AND e2 IS NULL AS is_valid FROM v)"""
SPECTRUM = """p AS (SELECT vec_id, k, i, a[i + 1] AS x FROM s, range(33) k(k), range(64) i(i)),
m AS (SELECT vec_id, k, sqrt(sum(x * cos(2 * pi() * ((k * i) % 64) / 64)) ** 2 + sum(x * sin(2 * pi() * ((k * i) % 64) / 64)) ** 2) AS m FROM p GROUP BY vec_id, k),
g AS (SELECT *, sum(m) OVER (PARTITION BY vec_id) AS t, sum(m) OVER (PARTITION BY vec_id ORDER BY k) AS run,
             sum(m + 1e-10) OVER (PARTITION BY vec_id) AS t1 FROM m),
q AS (SELECT vec_id, sum(k * m) / any_value(t) AS centroid, exp(avg(ln(m + 1e-10))) / avg(m + 1e-10) AS flatness,
             exp(avg(ln(m + 1e-10))) / (avg(m) + 1e-10) AS flatness_score,
             count(*) FILTER (run < 0.85 * t) AS rolloff, -sum((m + 1e-10) / t1 * log2((m + 1e-10) / t1)) / log2(33) AS entropy FROM g GROUP BY vec_id)"""
WINDOWED = """n AS (
  SELECT vec_id, var_pop(r) AS vr, var_pop(z) AS vz FROM (
    SELECT vec_id, sqrt(list_sum(list_transform(w, lambda x: x * x)) / 16) AS r,
           list_sum(list_transform(range(1, 16), lambda i: abs(sign(w[i + 1])::DOUBLE - sign(w[i])))) / 32.0 AS z
    FROM (SELECT vec_id, a[k * 16 + 1 : k * 16 + 16] AS w FROM s, range(4) k(k))) GROUP BY vec_id)"""
SCORED = f"""{ARRAYS}, {FEATURES}, {CHECKED}, {SPECTRUM}, {WINDOWED},
o AS (SELECT c.vec_id, c.is_valid, c.snr_db, c.duration,
  least(greatest(0.6 * (1 - least(centroid / 4000.0, 1)) + 0.4 * (1 - flatness_score), 0), 1) AS clarity,
  1 / (1 + exp(-5 * (least(snr_db / 40, 1) - 0.5))) AS snr,
  least(greatest(0.6 / (1 + 100 * vr) + 0.4 / (1 + 50 * vz), 0), 1) AS naturalness,
  least(greatest(entropy, 0), 1) AS diversity,
  least(1, greatest(0, least(1, 1 + least(snr_db / 50, 0.2)) - 2 * greatest(0, peak - 0.9)) + least(rms * 50, 0.1)) AS technical
  FROM c JOIN q USING (vec_id) JOIN n USING (vec_id)),
z AS (SELECT vec_id, is_valid, snr_db, duration, {", ".join(f"round(CASE WHEN is_valid THEN {k} ELSE 0 END, 5) AS {k}_score" for k in validation.WEIGHTS)},
  CASE WHEN is_valid THEN {" + ".join(f"{w} * {k}" for k, w in validation.WEIGHTS.items())} ELSE 0 END AS overall FROM o)"""
STATISTICS = ", ".join(
    f"round(avg({c}), 6) AS {c}_mean, round(stddev_pop({c}), 6) AS {c}_std, round(min({c}), 6) AS {c}_min, round(max({c}), 6) AS {c}_max" for c in ("duration", "peak", "rms", "zcr", "snr_db")
).replace("(duration)", "(CASE WHEN is_valid THEN duration END)")
for _c in ("peak", "rms", "zcr", "snr_db"):
    STATISTICS = STATISTICS.replace(f"({_c})", f"(CASE WHEN is_valid THEN {_c} END)")


def _transform_sql(y: str, before: str = "") -> str:
    return f"""WITH {ARRAYS}, {before} y AS (SELECT vec_id, {y} AS y FROM {'b' if before else 's'})
SELECT vec_id, len(y)::BIGINT AS n, round(list_sum(y), 5) AS sum, round(sqrt(list_sum(list_transform(y, lambda x: x * x)) / len(y)), 5) AS rms, round(y[len(y)], 5) AS last FROM y"""


LEVEL = "20 * log10(abs(x) + 1e-10)"
def augment_profiles(spark, sf_dir):
    """Two profiles: far (distance, echo) and cheap (distortion, codec); a clip in ten is broken."""
    clips = load(spark, sf_dir).withColumn("samples", F.when(F.col("vec_id") % 10 != 3, F.col("samples")))
    profiles = {"far": [("distance", {"metres": 2.0}), ("echo", {"delay": 5, "level": 0.5})], "plain": []}
    held = augmentation.augment_profiles(clips, profiles, to_rate=RATE)
    return held.select("vec_id", "profile", F.coalesce("augment_error", F.lit("")).alias("error"), _r(F.coalesce(S.energy(F.col("augmented")), F.lit(-1.0)), 9).alias("energy"))


def score_means(spark, sf_dir):
    held = validation.component_means(validation.score(validation.validate(load(spark, sf_dir), CHECKS), window=WINDOW))
    return held.select("component", _r("mean", 3))


def event_overlay(spark, sf_dir):
    """The first 16 samples, under an envelope, added again from sample 40 on."""
    event = S.ramps(F.slice("samples", 1, 16), 4, 8)
    return load(spark, sf_dir).select("vec_id", _r(S.energy(S.overlay(F.col("samples"), event, 40, 0.5)), 9).alias("energy"))


def event_table_overlay(spark, sf_dir):
    """Every row of events as a sound of 1 to 24 rising samples, laid over its user's clip from a sample of its own on; some
    begin before the clip, some past its end."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    size = (F.col("event_id") % 24 + 1).cast("int")
    sound = F.transform(F.sequence(F.lit(1), size), lambda j: F.col("value") / 1000 * j / size)
    sounds = rows.select(F.col("user_id").alias("vec_id"), (F.col("event_id") % 80 - 4).alias("start"), sound.alias("sound"))
    held = overlay.overlay_events(load(spark, sf_dir), sounds, id="vec_id")
    return held.select("vec_id", F.size("samples").cast("long").alias("n"), _r(S.total(F.col("samples")), 5).alias("sum"), _r(S.rms(F.col("samples")), 5).alias("rms"), _r(F.col("samples")[63], 5).alias("last"))


def event_sounds(spark, sf_dir):
    """The random events of two minutes for each clip, as they sound at 8 kHz."""
    held = load(spark, sf_dir).select("vec_id", F.inline(degrade.random_events(F.col("vec_id"), 120.0, 1.0)))
    held = held.withColumn("y", noise.event_sounds(F.col("type"), F.col("duration"), F.concat_ws(":", "vec_id", "start"), 8_000))
    return held.select("vec_id", "type", _r("start", 5), F.size("y").cast("long").alias("n"), _r(S.peak(F.col("y")), 6).alias("peak"), _r(S.rms(F.col("y")), 5).alias("rms"))


def _effect(make):
    def query(spark, sf_dir):
        held = load(spark, sf_dir).withColumn("y", make(F.col("samples"), F.col("vec_id")))
        return held.select("vec_id", F.size("y").cast("long").alias("n"), _r(S.rms(F.col("y")), 5).alias("rms"), _r(S.peak(F.col("y")), 5).alias("peak"))

    return query


def microphone_chain(spark, sf_dir):
    """Every clip through each of the six microphones, as if it were sampled at their rates."""
    profiles = {name: [("microphone", {"name": name})] for name in microphone.RESPONSES}
    held = augmentation.augment_profiles(load(spark, sf_dir).withColumn("sample_rate", F.lit(24_000)), profiles, key="vec_id")
    return held.select("vec_id", "profile", _r(S.rms(F.col("augmented")), 5).alias("rms"), _r(F.col("augmented")[63], 5).alias("last"))


def phone_profiles(spark, sf_dir):
    """Every clip over each of the known kinds of telephone, as if sampled at 24 kHz."""
    profiles = {p[0]: [("telephone", {"name": p[0]})] for p in presets.PHONES}
    held = augmentation.augment_profiles(load(spark, sf_dir).withColumn("sample_rate", F.lit(24_000)), profiles, key="vec_id")
    return held.select("vec_id", "profile", _r(S.rms(F.col("augmented")), 5).alias("rms"), _r(F.col("augmented")[63], 5).alias("last"))


def score_chart(spark, sf_dir):
    """The 20 bars of the overall scores, empty ones too."""
    held = assessment.assess(load(spark, sf_dir), CHECKS, window=WINDOW).withColumn("score", F.round("overall_score", 5))
    return summary.equal_width_histogram(held, "score", 20, empty=True).select("bucket", _r("low", 6), _r("high", 6), "count")


def score_points(spark, sf_dir):
    """Noise ratio and overall score of every clip that has both."""
    held = assessment.assess(load(spark, sf_dir), CHECKS, window=WINDOW).withColumn("score", F.round("overall_score", 5))
    return summary.points(held, "vec_id", "snr_db", "score").select("id", _r("x"), "y")


def augment_scenes(spark, sf_dir):
    """Noise with events, rooms, microphones, tempo, pitch, dynamics and losses in profiles of up to four steps."""
    clips = load(spark, sf_dir).withColumns({"sample_rate": F.lit(8_000), "samples": F.when(F.col("vec_id") % 10 == 3, F.array_repeat(F.lit(0.0), 64)).otherwise(F.col("samples"))})
    profiles = {
        "kitchen": [("noise", {"kind": "pink", "snr": (12.0, 20.0), "per_minute": 1.0}), ("room", {"name": "medium_room"}), ("microphone", {"name": "smartphone"})],
        "car": [("noise", {"kind": "brown", "snr": (8.0, 15.0)}), ("degradation_preset", {"name": "voip_call"}), ("dynamics_preset", {"name": "voice_compression"})],
        "child": [("voice_preset", {"name": "child_voice"}), ("degradation_preset", {"name": "old_recording"}), ("far", {"metres": 2.0})],
    }
    held = augmentation.augment_profiles(clips, profiles, to_rate=8_000, key="vec_id")
    return held.select("vec_id", "profile", F.coalesce("augment_error", F.lit("")).alias("error"), F.size("augmented").cast("long").alias("n"), _r(S.rms(F.col("augmented")), 5).alias("rms"))


SQL = {
    "score_chart": f"""WITH {SCORED}, xs AS (SELECT round(overall, 5) AS x FROM z), lim AS (SELECT min(x) AS lo, max(x) AS hi, (max(x) - min(x)) / 20 AS w FROM xs),
bars AS (SELECT least(floor((x - lo) / w), 19)::INT AS bar, count(*) AS held FROM xs, lim GROUP BY 1)
SELECT r.b::INT AS bucket, round(lo + r.b * w, 6) AS low, round(lo + (r.b + 1) * w, 6) AS high, coalesce(held, 0) AS count FROM lim, range(20) r(b) LEFT JOIN bars ON bar = r.b""",
    "score_points": f"WITH {SCORED} SELECT vec_id::VARCHAR AS id, round(snr_db, 6) AS x, round(overall, 5) AS y FROM z WHERE isfinite(snr_db)",
    "record_files": """SELECT vec_id, label::BIGINT AS label, 'clip_' || vec_id AS filename, CASE WHEN vec_id % 10 < 8 THEN 'train' WHEN vec_id % 10 = 8 THEN 'val' ELSE 'test' END AS split,
  len(embedding)::BIGINT AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS sum FROM embeddings""",
    "error_counts": f"""WITH {ARRAYS}, {FEATURES}, {CHECKED},
e AS (SELECT CASE vec_id % 10 WHEN 3 THEN 'AudioError' WHEN 4 THEN 'NoiseError' ELSE 'QualityAssuranceError' END AS kind, CASE WHEN vec_id % 10 IN (3, 4) THEN 'augment' ELSE 'validate' END AS stage FROM c WHERE vec_id % 10 IN (3, 4) OR error IS NOT NULL),
u AS (SELECT kind, stage, unnest(CASE kind WHEN 'NoiseError' THEN ['NoiseError', 'AugmentationError', 'Error'] ELSE [kind, 'Error'] END) AS class FROM e)
SELECT class, stage, count(*) FILTER (class = kind) AS own, count(*) AS total FROM u GROUP BY class, stage""",
    "event_table_overlay": """WITH e AS (SELECT user_id AS vec_id, event_id % 80 - 4 AS began, event_id % 24 + 1 AS n, value FROM events),
p AS (SELECT vec_id, began + j - 1 AS i, value / 1000 * j / n AS v FROM e, range(1, 25) r(j) WHERE j <= n AND began BETWEEN 0 AND 63 AND began + j - 1 < 64),
l AS (SELECT vec_id, i, sum(v) AS v FROM p GROUP BY ALL),
y AS (SELECT c.vec_id, i.i, c.embedding[i.i + 1]::DOUBLE + coalesce(l.v, 0) AS y FROM embeddings c, range(64) i(i) LEFT JOIN l ON l.vec_id = c.vec_id AND l.i = i.i)
SELECT vec_id, count(*) AS n, round(sum(y), 5) AS sum, round(sqrt(avg(y * y)), 5) AS rms, round(max(y) FILTER (i = 63), 5) AS last FROM y GROUP BY vec_id""",
    "resample_band": """WITH b AS (SELECT p, t, 0.69 * CASE WHEN t * 3 = p THEN 1 ELSE sin(pi() * 0.69 * (t - p / 3.0)) / (pi() * 0.69 * (t - p / 3.0)) END
    * list_sum(list_transform(range(0, 40), lambda k: (4.0 * sqrt(greatest(1 - ((t - p / 3.0) / 70) ** 2, 0))) ** (2 * k) / gamma(k + 1.0) ** 2)) AS h FROM range(3) p(p), range(-69, 71) t(t)),
h AS (SELECT p, t, h / sum(h) OVER (PARTITION BY p) AS h FROM b),
y AS (SELECT vec_id, j, sum(embedding[j * 4 // 3 + t + 1]::DOUBLE * h) AS y FROM embeddings, range(48) j(j), h WHERE p = j * 4 % 3 AND j * 4 // 3 + t BETWEEN 0 AND 63 GROUP BY ALL)
SELECT vec_id, count(*) AS n, round(sum(y), 5) AS sum, round(sqrt(avg(y * y)), 5) AS rms, round(max(y) FILTER (j = 47), 5) AS last FROM y GROUP BY vec_id""",
    "signal_features": f"WITH {ARRAYS}, {FEATURES} SELECT vec_id, label, round(duration, 6) AS duration, round(peak, 6) AS peak, round(rms, 6) AS rms, round(zcr, 6) AS zcr, round(snr_db, 6) AS snr_db FROM f",
    "validate_signals": f"WITH {ARRAYS}, {FEATURES}, {CHECKED} SELECT vec_id, is_valid, error, round(peak, 6) AS peak, round(snr_db, 6) AS snr_db FROM c",
    "dataset_statistics": f"WITH {ARRAYS}, {FEATURES}, {CHECKED} SELECT label, count(*)::BIGINT AS total, count(*) FILTER (is_valid)::BIGINT AS valid, count(*) FILTER (NOT is_valid)::BIGINT AS invalid, {STATISTICS} FROM c GROUP BY label",
    "spectral_features": f"WITH {ARRAYS}, {SPECTRUM} SELECT vec_id, round(centroid, 6) AS centroid, round(centroid, 6) AS centroid_hz, round(flatness, 6) AS flatness, rolloff::BIGINT AS rolloff, round(entropy, 6) AS entropy FROM q",
    "quality_scores": f"WITH {SCORED} SELECT vec_id, is_valid, {', '.join(f'{k}_score' for k in validation.WEIGHTS)}, round(overall, 5) AS overall_score FROM z",
    "score_histogram": f"""WITH {SCORED}, h AS (SELECT unnest([0, 1, 2, 3, 4]) AS bucket)
SELECT bucket::INT AS bucket, (bucket * 2 / 10.0)::VARCHAR || '-' || ((bucket + 1) * 2 / 10.0)::VARCHAR AS label,
       (SELECT count(*) FROM z WHERE round(overall, 5) >= bucket * 0.2 AND (round(overall, 5) < (bucket + 1) * 0.2 OR (bucket = 4 AND round(overall, 5) <= 1)))::BIGINT AS count FROM h""",
    "signal_moments": f"""WITH {ARRAYS}, e AS (SELECT vec_id, unnest(a) AS x FROM s), b AS (SELECT vec_id, avg(x) AS u, stddev_pop(x) AS d FROM e GROUP BY vec_id)
SELECT vec_id, round(any_value(u), 6) AS mean, round(any_value(d), 6) AS std, round(avg(((x - u) / d) ** 3), 5) AS skewness, round(avg(((x - u) / d) ** 4) - 3, 5) AS kurtosis FROM e JOIN b USING (vec_id) GROUP BY vec_id""",
    "cosine_duplicates": """SELECT x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(list_transform(x.embedding, lambda v: v::DOUBLE), list_transform(y.embedding, lambda v: v::DOUBLE)), 4) AS similarity
FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id WHERE list_cosine_similarity(list_transform(x.embedding, lambda v: v::DOUBLE), list_transform(y.embedding, lambda v: v::DOUBLE)) >= 0.4""",
    "report_table": f"WITH {SCORED} SELECT vec_id, round(duration, 2) AS duration, round(snr_db, 1) AS snr_db, round(overall, 3) AS overall_score, CASE WHEN is_valid THEN '✓' ELSE '✗' END AS valid FROM z ORDER BY vec_id LIMIT 50",
    "bit_depth": _transform_sql("list_transform(a, lambda x: round_even(x * 127, 0) / 127)"),
    "mic_distortion": _transform_sql("list_transform(a, lambda x: x * (1 - sqrt(0.15)) + (1 - 2 / (exp(2 * x * 1.3) + 1)) * (0.8 - 0.6 * 0.15) * sqrt(0.15))"),
    "distance_gain": _transform_sql("list_transform(a, lambda x: x * (0.3 / 2.0) ** 1.5)"),
    "echo": _transform_sql("list_transform(range(1, 65), lambda i: a[i] + CASE WHEN i > 5 THEN a[i - 5] * 0.4 ELSE 0 END)"),
    "compressor": _transform_sql(f"list_transform(a, lambda x: x * 10 ** (-(CASE WHEN {LEVEL} > -22.5 AND {LEVEL} < -17.5 THEN 0 ELSE greatest({LEVEL} + 20, 0) END) * 0.75 / 20))"),
    "expander": _transform_sql(f"list_transform(a, lambda x: x * 10 ** (-greatest(-20 - {LEVEL}, 0) / 20))"),
    "linear_resample": _transform_sql(
        "list_transform(range(0, 48), lambda i: a[floor(i * 63 / 47)::INT + 1] + (a[least(floor(i * 63 / 47)::INT + 1, 63) + 1] - a[floor(i * 63 / 47)::INT + 1]) * (i * 63 / 47 - floor(i * 63 / 47)))"
    ),
    "codec_quantise": _transform_sql("list_transform(a, lambda x: least(greatest(round_even(x * 128, 0) / 128, -1), 1))"),
    "pad_signal": _transform_sql("list_transform(range(1, 101), lambda i: coalesce(a[i], 0))"),
    "reverb_taps": _transform_sql("list_transform(range(1, 65), lambda i: a[i] + CASE WHEN i > 3 THEN a[i - 3] * 0.5 ELSE 0 END + CASE WHEN i > 7 THEN a[i - 7] * 0.25 ELSE 0 END + CASE WHEN i > 20 THEN a[i - 20] * 0.1 ELSE 0 END)"),
    "phone_band": f"""WITH {ARRAYS}, c AS (SELECT vec_id, k, sum(a[i + 1] * cos(2 * pi() * ((k * i) % 64) / 64)) AS re, sum(a[i + 1] * sin(2 * pi() * ((k * i) % 64) / 64)) AS im FROM s, range(33) k(k), range(64) i(i) GROUP BY vec_id, k),
g AS (SELECT vec_id, k, re, im, CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END / 64.0 / (1 + (4 / greatest(k, 1e-9)) ** 2) / (1 + (k / 16.0) ** 4) AS g FROM c),
y AS (SELECT vec_id, i, sum(g * (re * cos(2 * pi() * ((k * i) % 64) / 64) + im * sin(2 * pi() * ((k * i) % 64) / 64))) AS y FROM g, range(64) i(i) GROUP BY vec_id, i)
SELECT vec_id, round(sum(y), 5) + 0.0 AS sum, round(sqrt(sum(y * y) / 64), 5) AS rms FROM y GROUP BY vec_id""",
    "snr_mix": """WITH x AS (SELECT s.vec_id, list_transform(s.embedding, lambda v: v::DOUBLE) AS a, list_transform(n.embedding, lambda v: v::DOUBLE) AS b FROM embeddings s JOIN embeddings n ON n.vec_id = s.vec_id + 1),
g AS (SELECT *, sqrt(list_sum(list_transform(a, lambda v: v * v)) / (list_sum(list_transform(b, lambda v: v * v)) * 10)) AS g FROM x),
u AS (SELECT vec_id, list_transform(range(1, 65), lambda i: a[i] + g * b[i]) AS u FROM g),
y AS (SELECT vec_id, list_transform(u, lambda v: v * 0.95 / list_max(list_transform(u, lambda w: abs(w)))) AS y FROM u)
SELECT vec_id, round(list_sum(y), 5) AS sum, round(sqrt(list_sum(list_transform(y, lambda v: v * v)) / 64), 5) AS rms, round(y[64], 5) AS last FROM y""",
    "dft_bandpass": f"""WITH {ARRAYS}, c AS (SELECT vec_id, k, sum(a[i + 1] * cos(2 * pi() * ((k * i) % 64) / 64)) AS re, sum(a[i + 1] * sin(2 * pi() * ((k * i) % 64) / 64)) AS im FROM s, range(4, 17) k(k), range(64) i(i) GROUP BY vec_id, k),
y AS (SELECT vec_id, i, 2.0 / 64 * sum(re * cos(2 * pi() * ((k * i) % 64) / 64) + im * sin(2 * pi() * ((k * i) % 64) / 64)) AS y FROM c, range(64) i(i) GROUP BY vec_id, i)
SELECT vec_id, round(sum(y), 5) + 0.0 AS sum, round(sqrt(sum(y * y) / 64), 5) AS rms FROM y GROUP BY vec_id""",
    "augment_profiles": f"""WITH {ARRAYS}, y AS (SELECT vec_id, list_transform(range(1, 65), lambda i: pow(0.15, 1.5) * (a[i] + CASE WHEN i > 5 THEN 0.5 * a[i - 5] ELSE 0 END)) AS far, a AS plain FROM s),
p AS (SELECT vec_id, 'far' AS profile, far AS y FROM y UNION ALL SELECT vec_id, 'plain', plain FROM y)
SELECT vec_id, profile, CASE WHEN vec_id % 10 = 3 THEN 'no samples' ELSE '' END AS error,
       CASE WHEN vec_id % 10 = 3 THEN -1 ELSE round(list_sum(list_transform(y, lambda v: v * v)) / 64, 9) END AS energy FROM p""",
    "score_means": f"WITH {SCORED} " + " UNION ALL ".join(f"SELECT '{k}' AS component, round(avg({k if k == 'overall' else k + '_score'}), 3) AS mean FROM z WHERE is_valid" for k in (*validation.WEIGHTS, "overall")),
    "event_overlay": f"""WITH {ARRAYS}, y AS (SELECT vec_id, list_transform(range(0, 64), lambda i: a[i + 1] + CASE WHEN i BETWEEN 40 AND 55 THEN 0.5 * a[i - 39] * least((i - 40) / 4.0, 1) * least((55 - i) / 8.0, 1) ELSE 0 END) AS y FROM s)
SELECT vec_id, round(list_sum(list_transform(y, lambda v: v * v)) / 64, 9) AS energy FROM y""",
}
QUERIES = {
    "signal_features": signal_features,
    "validate_signals": validate_signals,
    "dataset_statistics": dataset_statistics,
    "spectral_features": spectral_features,
    "quality_scores": quality_scores,
    "score_histogram": score_histogram,
    "signal_moments": signal_moments,
    "signal_embedding": signal_embedding,
    "cosine_duplicates": cosine_duplicates,
    "record_files": record_files,
    "error_counts": error_counts,
    "near_signals": near_signals,
    "near_duplicate_clips": near_duplicate_clips,
    "report_table": report_table,
    "bit_depth": _transform(lambda a: S.quantise(a, 8)),
    "mic_distortion": _transform(lambda a: S.distort(a, 0.15)),
    "distance_gain": _transform(lambda a: S.distance_gain(a, 2.0)),
    "echo": _transform(lambda a: S.echo(a, 5, 0.4)),
    "compressor": _transform(lambda a: S.compress(a)),
    "expander": _transform(lambda a: S.expand(a, -20.0, 2.0)),
    "limiter": _transform(lambda a: S.limit(a, -12.0, 8)),
    "codec_quantise": _transform(lambda a: S.codec(a, 8)),
    "pad_signal": _transform(lambda a: S.fit_length(a, 100)),
    "reverb_taps": _transform(lambda a: S.reverb(a, [3, 7, 20], [0.5, 0.25, 0.1])),
    "phone_band": phone_band,
    "packet_loss": packet_loss,
    "random_events": random_events,
    "linear_resample": _transform(lambda a: S.resample(a, F.lit(48))),
    "snr_mix": snr_mix,
    "dft_bandpass": dft_bandpass,
    "augment_profiles": augment_profiles,
    "score_means": score_means,
    "event_overlay": event_overlay,
    "event_table_overlay": event_table_overlay,
    "event_sounds": event_sounds,
    "resample_band": _transform(lambda a: resampling.to_rate(a, F.lit(RATE), 48)),
    "speed_change": _effect(lambda a, k: resampling.change_speed(a, 1.25)),
    "time_stretch": _effect(lambda a, k: vocoder.time_stretch(a, 0.8)),
    "pitch_shift": _effect(lambda a, k: vocoder.pitch_shift(a, 4.0)),
    "microphone_chain": microphone_chain,
    "dropouts": _effect(lambda a, k: damage.dropouts(a, k, 1_000, 0.05)),
    "random_losses": _effect(lambda a, k: damage.random_losses(a, k, 24_000, 0.7)),
    "augment_scenes": augment_scenes,
    "phone_profiles": phone_profiles,
    "score_chart": score_chart,
    "score_points": score_points,
}
