"""Quality rules: fixed word rules, then robust multivariate outliers per language and source.

Each document gives counts over its whole text; shares of them, smoothed and transformed, form a vector. Every
(lang, source) group of ``min_group`` documents or more has a minimum-covariance-determinant estimate of its own;
the smaller groups of a language have one together, and those of languages too small for that one more. An
estimate begins from several deterministic starts around the coordinate medians (spreads between quartiles, the
correlation of hyperbolic tangents, spatial signs). Each takes concentration steps: distances of all rows, the
least limit that holds the core share, mean and covariance of the rows within it. After ``first_steps`` the start
with the least determinant goes on, until no group's determinant falls any more. Covariances carry the factor
that makes them consistent for normal vectors and a small fixed diagonal, so constant coordinates stay invertible.
Documents whose squared Mahalanobis distance exceeds the chi-square quantile ``quantile`` are rejected.

Every step is an aggregation with map-side combining over all documents, so a group with a third of the rows is no
single task. Limits come from counts of fine bins (65,536 to a factor e of one plus the value), rows of the limit's
own bin included, so they do not depend on how rows are dealt out.

Defined results: null text has no words and fails the base rules; null lang or source is a group of its own;
repeated rows each count and each give a row; documents that fail the base rules take no part in the
estimates and have no distance; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curaspark.llm.common import WORD, Scratch, join_counted

SYMBOLS = "#*$%&|<>"
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 5, 10, 20
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_chars", "n_upper", "n_marks", "n_lines"]
VECTOR = ["v_word", "v_symbol", "v_upper", "v_mark", "v_dup"]
#: Smallest spread a coordinate may show, so that constant coordinates keep the covariance invertible.
FLOOR = [0.08, 0.10, 0.06, 0.06, 0.10]
CORE_SHARE, MIN_GROUP, QUANTILE = 0.75, 100, 0.99999
#: Steps of every start, and steps at most of the one that goes on; the loop ends before when determinants stand still.
FIRST_STEPS, MAX_STEPS, STILL = 2, 60, 1e-6
STARTS = 3
#: Bins to a factor e.
BINS = 65_536
#: Bytes of texts turned into strings at once, unless a single text is longer.
BYTES_AT_ONCE = 4 << 20
COUNTED = "struct<" + ", ".join(f"{c}: bigint" for c in COUNTS + MORE) + ">"


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words inside a window that occurs at least twice, every occurrence included."""
    grams = list(zip(*(words[i:] for i in range(window))))
    seen = Counter(grams)
    if len(seen) == len(grams):
        return 0
    count = end = 0
    for i, g in enumerate(grams):
        if seen[g] > 1:
            count += i + window - max(i, end)
            end = i + window
    return count


def text_counts(text: str) -> tuple[int, ...]:
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    joined = "".join(words)
    upper = sum(map(str.isupper, joined))
    letters = sum(map(str.isalpha, joined))
    return (
        len(words),
        len(joined),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(text),
        upper,
        len(joined) - letters,
        len(lines),
    )


def _counts(texts: pa.Array) -> pa.Array:
    sizes, rows, at, held = pc.fill_null(pc.binary_length(texts), 0).to_pylist(), [], 0, 0
    for i, size in enumerate([*sizes, BYTES_AT_ONCE + 1]):
        if held + size > BYTES_AT_ONCE or i == len(sizes):
            rows += [text_counts(t or "") for t in texts.slice(at, i - at).to_pylist()]
            at, held = i, 0
        held += size
    columns = list(zip(*rows)) or [()] * len(COUNTS + MORE)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], COUNTS + MORE)


def _count_texts(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for part in texts:
        yield _counts(part)


def count_texts(docs: DataFrame, *, text="text", lang="lang", source="source") -> DataFrame:
    """docs with __quality: the counts, whether the base rules fail, the vector, and the number of the group. Only texts go to Python."""
    key = lambda c: (F.col(c).isNull(), F.coalesce(F.col(c).cast("string"), F.lit("")))
    counted = docs.withColumn("__quality", F.arrow_udf(_count_texts, COUNTED)(F.col(text)))
    own = F.struct(F.xxhash64(F.lit(1), *key(lang)).alias("lang"), F.xxhash64(F.lit(0), *key(lang), *key(source)).alias("own"))
    return counted.withColumn("__quality", F.struct("__quality.*", own.alias("of"), *[c.alias(n) for n, c in vectors(lambda c: F.col("__quality")[c]).items()]))


def vectors(of: Callable[[str], Column]) -> dict[str, Column]:
    """Smoothed, transformed shares: logarithm of the mean word length, arc sines of square roots of shares."""
    share = lambda part, whole, k: F.asin(F.sqrt(F.least((of(part) + 0.5) / (of(whole) + k), F.lit(1.0))))
    return {
        "base_failed": (of("n_words") < MIN_WORDS) | (100 * of("n_repeat_words") > MAX_REPEAT_PERCENT * of("n_words")),
        "v_word": F.log((of("word_chars") + 250) / (of("n_words") + 50)),
        "v_symbol": share("n_symbols", "n_chars", 200),
        "v_upper": share("n_upper", "word_chars", 200),
        "v_mark": share("n_marks", "word_chars", 200),
        "v_dup": share("n_dup_lines", "n_lines", 20),
    }


def chi_square(x: float, k: int) -> float:
    """The share of a chi-square distribution of k degrees below x, by the series of the incomplete gamma function."""
    term = total = 1 / (k / 2)
    n = k / 2
    while term > 1e-17 * total:
        n += 1
        term *= x / 2 / n
        total += term
    return total * math.exp(k / 2 * math.log(x / 2) - x / 2 - math.lgamma(k / 2))


def chi_square_quantile(share: float, k: int) -> float:
    low, high = 1e-9, 1e4
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, k) < share else (low, middle)
    return high


def consistency(core: float, k: int) -> float:
    """What the covariance of the core of normal vectors is too small by."""
    return core / chi_square(chi_square_quantile(core, k), k + 2)


def bin_of(value: Column) -> Column:
    """Fine bins in the order of non-negative values."""
    return F.floor(F.log1p(value) * BINS)


def limits(rows: DataFrame, keys: list[str], value: Column, shares: dict[str, float]) -> DataFrame:
    """By keys, for each share, the least bin up to which so much of the rows lie. What is gathered is bounded by the bins."""
    counts = rows.groupBy(*keys, bin_of(value).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    below = F.sum("n").over(Window.partitionBy(*keys).orderBy("bin"))
    counts = counts.select(*keys, "bin", below.alias("below"), F.sum("n").over(Window.partitionBy(*keys)).alias("all"))
    return counts.groupBy(*keys).agg(*[F.min(F.when(F.col("below") >= F.ceil(F.col("all") * s), F.col("bin"))).alias(n) for n, s in shares.items()])


PAIRS = [(i, j) for i in range(len(VECTOR)) for j in range(i, len(VECTOR))]
ESTIMATE_SCHEMA = "of long, start int, logdet double, m array<double>, inverse array<double>"


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Means and covariances by group."""
    means, covariances = [F.avg(v) for v in VECTOR], [F.covar_pop(VECTOR[i], VECTOR[j]) for i, j in PAIRS]
    return rows.groupBy(*keys).agg(F.array(*means).alias("m"), F.array(*covariances).alias("c"))


def _invert(frames: Iterator[pd.DataFrame], factor: float) -> Iterator[pd.DataFrame]:
    """Covariances, made consistent and with the floor on the diagonal, to inverses and logarithms of determinants."""
    d = len(VECTOR)
    for f in frames:
        cov = np.zeros((len(f), d, d))
        for k, (i, j) in enumerate(PAIRS):
            cov[:, i, j] = cov[:, j, i] = [c[k] for c in f["c"]]
        cov = factor * cov + np.diag(np.square(FLOOR))
        out = f[["of", "start", "m"]].assign(logdet=np.linalg.slogdet(cov)[1], inverse=list(np.linalg.inv(cov).reshape(len(f), d * d)))
        yield out[["of", "start", "logdet", "m", "inverse"]]


def squared_distance() -> Column:
    d = len(VECTOR)
    diff = [F.col(v) - F.col("m")[i] for i, v in enumerate(VECTOR)]
    whole = sum((diff[i] * diff[j] * F.col("inverse")[i * d + j] * (1 if i == j else 2) for i, j in PAIRS), F.lit(0.0))
    return F.greatest(whole, F.lit(0.0))


def starts(rows: DataFrame, scratch: Scratch, groups: int) -> DataFrame:
    """of, start, m, c: the medians with three covariances, of coordinates measured in spreads between quartiles."""
    each = rows.select("of", F.posexplode(F.array(*VECTOR)).alias("at", "value"))
    edges = limits(each, ["of", "at"], F.col("value"), {"low": 0.25, "middle": 0.5, "high": 0.75})
    edge = lambda c: F.expm1((F.col(c) + 0.5) / BINS)
    spread = F.greatest((edge("high") - edge("low")) / 1.349, F.element_at(F.array(*map(F.lit, FLOOR)), F.col("at") + 1))
    scales = edges.groupBy("of").agg(F.array_sort(F.collect_list(F.struct("at", edge("middle").alias("m"), spread.alias("s")))).alias("x"))
    scales = scratch.put(scales.select("of", F.col("x.m").alias("m"), F.col("x.s").alias("s")), "scales")  # five numbers a group
    z = [((F.col(v) - F.col("m")[i]) / F.col("s")[i]).alias(f"z{i}") for i, v in enumerate(VECTOR)]
    held = join_counted(rows, scales, "of", "inner", groups).select("of", "m", "s", *z)
    square = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(len(z))), F.lit(1e-12))
    tanh = [F.tanh(f"z{i}") for i in range(len(z))]
    sums = held.groupBy("of", "m", "s").agg(
        F.array(*[F.covar_pop(tanh[i], tanh[j]) for i, j in PAIRS]).alias("tanh"),
        F.array(*[F.avg(F.col(f"z{i}") * F.col(f"z{j}") / square) for i, j in PAIRS]).alias("signs"),
    )
    own = {i: k for k, (i, j) in enumerate(PAIRS) if i == j}
    scale = [F.col("s")[i] * F.col("s")[j] for i, j in PAIRS]
    width = lambda i: F.greatest(F.sqrt(F.col("tanh")[own[i]]), F.lit(1e-9))
    covariances = [
        [scale[k] if i == j else F.lit(0.0) for k, (i, j) in enumerate(PAIRS)],
        [scale[k] * F.col("tanh")[k] / (width(i) * width(j)) for k, (i, j) in enumerate(PAIRS)],
        [scale[k] * F.col("signs")[k] * len(VECTOR) for k in range(len(PAIRS))],
    ]
    return sums.select("of", "m", F.posexplode(F.array(*[F.array(*c) for c in covariances])).alias("start", "c"))


def estimate(rows: DataFrame, scratch: Scratch, *, core=CORE_SHARE, first_steps=FIRST_STEPS, max_steps=MAX_STEPS) -> DataFrame:
    """rows(of, v_*) to the minimum-covariance-determinant estimate of each group: of, start, logdet, m, inverse."""
    factor, groups = consistency(core, len(VECTOR)), rows.select("of").distinct().count()
    invert = lambda found: found.mapInPandas(lambda frames: _invert(frames, factor), ESTIMATE_SCHEMA)
    now = scratch.put(invert(starts(rows, scratch, groups)), "start")
    for step in range(1, max_steps + 1):
        measured = join_counted(rows, now, "of", "inner", groups * STARTS).withColumn("distance", squared_distance())
        edges = limits(measured, ["of", "start"], F.col("distance"), {"edge": core})
        inside = join_counted(measured, edges, ["of", "start"], "inner", groups * STARTS).where(bin_of(F.col("distance")) <= F.col("edge"))
        before, now = now, scratch.put(invert(_moments(inside, ["of", "start"])), f"step{step}")
        if step == first_steps:
            best = now.groupBy("of").agg(F.min_by("start", F.struct("logdet", "start")).alias("start"))
            now = scratch.put(now.join(best, ["of", "start"]), "best")
        elif step > first_steps:
            fall = now.alias("x").join(before.alias("y"), "of").agg(F.max(F.col("y.logdet") - F.col("x.logdet"))).first()[0]
            if not (fall or 0.0) > STILL:
                break
    return now


def grouped(rows: DataFrame, scratch: Scratch, min_group: int) -> tuple[DataFrame, DataFrame]:
    """Rows that pass the base rules to (of, v_*), of the group whose estimate they take part in; and own group to that group."""
    sizes = scratch.put(rows.groupBy("of").agg(F.count(F.lit(1)).alias("n")).select("of.*", "n"), "sizes")
    small = F.col("n") < min_group
    pools = sizes.where(small).groupBy("lang").agg((F.sum("n") >= min_group).alias("enough"))
    pooled = F.when(~small, F.col("own")).when(F.col("enough"), F.col("lang")).otherwise(0)
    assigned = scratch.put(sizes.join(pools, "lang", "left").select("own", pooled.alias("of")), "assigned")
    held = rows.select(F.col("of.own").alias("own"), *VECTOR)
    return scratch.put(join_counted(held, assigned, "own", "inner", assigned.count()).drop("own"), "vectors"), assigned


def judge(counted: DataFrame, scratch: Scratch, quantile: float, min_group: int) -> DataFrame:
    """Rows with __quality, which gets distance and kept."""
    rows, assigned = grouped(counted.select("__quality.*").where("not base_failed"), scratch, min_group)
    found = estimate(rows, scratch).select(F.col("of").alias("__quality_of"), "m", "inverse")
    found = scratch.put(assigned.join(found, F.col("of") == F.col("__quality_of")).select(F.col("own").alias("__quality_own"), F.struct("m", "inverse").alias("__quality_by")), "estimates")
    named = counted.withColumn("__quality_own", F.when(~F.col("__quality.base_failed"), F.col("__quality.of.own")))
    held = join_counted(named, found, "__quality_own", "left", found.count())
    d, q, by = len(VECTOR), F.col("__quality"), F.col("__quality_by")
    diff = [q[v] - by["m"][i] for i, v in enumerate(VECTOR)]
    distance = F.greatest(sum((diff[i] * diff[j] * by["inverse"][i * d + j] * (1 if i == j else 2) for i, j in PAIRS), F.lit(0.0)), F.lit(0.0))
    distance = F.when(by.isNotNull(), distance)
    kept = ~q["base_failed"] & (distance <= chi_square_quantile(quantile, d))
    return held.withColumn("__quality", F.struct("__quality.*", distance.alias("distance"), F.coalesce(kept, F.lit(False)).alias("kept"))).drop("__quality_own", "__quality_by")


def apply_quality_rules(docs: DataFrame, *, id="doc_id", text="text", lang="lang", source="source", quantile=QUANTILE, min_group=MIN_GROUP) -> DataFrame:
    """Per row: doc_id, the base counts, base_failed, distance and kept."""
    scratch = Scratch(docs.sparkSession, "quality")
    picked = docs.select(F.col(id).cast("long").alias("doc_id"), *[F.col(c).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))])
    counted = scratch.put(count_texts(picked).select("doc_id", "__quality"), "counts")
    judged = judge(counted, scratch, quantile, min_group)
    return judged.select("doc_id", *[F.col("__quality")[c].alias(c) for c in (*COUNTS, "base_failed", "kept", "distance")])


def keep_documents(docs: DataFrame, *, quantile=QUANTILE, min_group=MIN_GROUP, **columns) -> DataFrame:
    """The rows of docs that pass, with all their columns."""
    scratch = Scratch(docs.sparkSession, "quality")
    counted = scratch.put(count_texts(docs, **columns), "counts")
    return judge(counted, scratch, quantile, min_group).where("__quality.kept").select(docs.columns)
