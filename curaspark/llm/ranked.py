"""Ranked lexical search: a threshold-seeded join of items with all documents, exact to the last tie.

1. Documents become postings (row, doc_id, n, term, tf) of the items' terms alone, in one pass; an empty term stands for
   the document itself and carries the statistics.
2. Each term stores its greatest impacts, one for each of ``GROUPS`` groups of documents, which sums alone find. The kth
   of them bounds the term's kth impact from below (and is it, unless two of the k best share a group).
3. An item's kth score is at least the greatest of its terms' kth impacts, and at least the kth of the scores that the
   documents stored with its terms have. That is its threshold.
4. Its terms stand in the order of their greatest impacts. As long as these sum to less than the threshold, a document
   that holds no other term of the item cannot be among its k best, so those terms generate no candidates.
5. Documents with one of the other terms are candidates if what they have reached plus the bounds of the terms left out
   reaches the threshold; their scores are then completed from the postings, exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curaspark.llm.common import BROADCAST_ROWS, Scratch, join_counted, text_of

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of terms that may be broadcast with at most BROADCAST_ROWS rows.
BROADCAST_BYTES = 32 << 20
#: Groups of documents for each result asked for, of which a term stores the greatest impact.
GROUPS = 8


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0))


def _small(terms: DataFrame) -> bool:
    n, size = terms.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    return n <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def _hinted(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def _classes(items: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(item_id, cls) of every item with a term, and (cls, term): items of equal terms are searched once."""
    each = scratch.put(items.select("item_id", F.explode(terms_of(text_of())).alias("term")).distinct(), "item_terms")
    mark = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "term"))
    marked = scratch.put(each.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), mark(1).alias("x"), mark(2).alias("y")), "marked")
    numbered = scratch.put(marked.select("n", "x", "y").distinct().withColumn("cls", F.monotonically_increasing_id()), "numbered")
    classes = scratch.put(marked.join(numbered, ["n", "x", "y"]).select("item_id", "cls"), "classes")
    of = classes.select(F.col("item_id").alias("own"), "cls")
    return classes, scratch.put(each.join(of, F.col("item_id").eqNullSafe(F.col("own"))).select("cls", "term").distinct(), "class_terms")


def _postings(docs: DataFrame, vocabulary: DataFrame, small: bool) -> DataFrame:
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", terms_of(text_of()).alias("terms"))
    each = rows.select("row", "doc_id", F.size("terms").cast("long").alias("n"), F.explode(F.concat("terms", F.array(F.lit("")))).alias("term"))
    keys = ["row", "doc_id", "n", "term"]
    if small:
        return each.join(F.broadcast(vocabulary), "term").groupBy(*keys).agg(F.count(F.lit(1)).alias("tf"))
    return each.groupBy(*keys).agg(F.count(F.lit(1)).alias("tf")).join(vocabulary, "term").select(*keys, "tf")


def _best(scores: DataFrame, by: str, k: int, *order: Column) -> DataFrame:
    """The k first rows of each group, with their rank; Spark cuts groups to k rows before it shuffles them."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def search(items: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank int, doc_id, score) of the k highest-scoring documents of each item, equal scores by doc_id.

    items (item_id, text), docs (doc_id, text). Null and empty texts have no terms: such documents are found by nothing
    and count for nothing, such items find nothing. Rows that repeat an item_id are one item with all their terms; rows
    without one are such an item too. Every row of docs is a document of its own, also where it repeats an id or has
    none (null ids come first among equal scores). Other columns are left out. Without items or documents there are no rows.
    """
    scratch = Scratch(docs.sparkSession, "ranked")
    classes, wanted = _classes(items.select("item_id", "text"), scratch)
    terms = wanted.select("term").distinct()
    vocabulary = terms.unionByName(terms.sparkSession.createDataFrame([("",)], "term string"))
    small = _small(terms)
    postings = scratch.put(_postings(docs.select("doc_id", "text"), vocabulary, small), "postings")
    documents, length = postings.where("term = ''").agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = postings.where("term <> ''")
    weight = F.floor(1000 * F.log(F.lit(float(2 * documents + 2)) / (2 * F.count(F.lit(1)) + 1))).cast("long")
    weights = scratch.put(held.groupBy("term").agg(weight.alias("w")), "weights")
    m = F.expr(f"100 - 90 + (90 * n * {documents}L) div {max(length, 1)}L")
    value = F.col("w") * F.expr("(1000000000 * tf) div (1000 * tf + 8 * m)")
    held = held.join(_hinted(weights, small), "term").withColumn("m", m).select("row", "doc_id", "term", value.alias("impact"))

    # Greatest impacts of each term.
    most = held.groupBy("term", F.pmod(F.xxhash64("row"), F.lit(GROUPS * k)).alias("part")).agg(F.max(F.struct("impact", "row")).alias("top"))
    tops = F.slice(F.sort_array(F.collect_list("top"), asc=False), 1, k)  # GROUPS * k at most
    stored = scratch.put(most.groupBy("term").agg(tops.alias("tops")), "stored")
    query = wanted.join(_hinted(stored, small), "term")
    kth = F.coalesce(F.get("tops", F.lit(k - 1))["impact"], F.lit(0))
    query = scratch.put(query.select("cls", "term", "tops", kth.alias("kth"), F.col("tops")[0]["impact"].alias("bound")), "query")

    n_query = query.count()

    # Thresholds, then which terms generate candidates.
    seeds = scratch.put(query.select("cls", F.explode("tops.row").alias("row")).distinct(), "seeds")
    found = join_counted(held.select("row", "term", "impact"), seeds, "row", "inner", seeds.count())
    sums = join_counted(found, query.select("cls", "term"), ["cls", "term"], "inner", n_query).groupBy("cls", "row").agg(F.sum("impact").alias("sum"))
    seeded = _best(sums, "cls", k, F.desc("sum"), F.col("row")).where(F.col("rank") == k).select("cls", F.col("sum").alias("least"))
    least = query.groupBy("cls").agg(F.max("kth").alias("least")).unionByName(seeded).groupBy("cls").agg(F.max("least").alias("least"))
    below = Window.partitionBy("cls").orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0)
    plan = query.select("cls", "term", "bound").join(least, "cls").withColumn("suffix", F.sum("bound").over(below)).withColumn("leads", F.col("suffix") >= F.col("least"))
    left_out = F.coalesce(F.sum(F.when(~F.col("leads"), F.col("bound"))).over(Window.partitionBy("cls")), F.lit(0))
    plan = scratch.put(plan.withColumn("rest", left_out), "plan")

    # Candidates, and what they still lack.
    leads, bounds = plan.where("leads").select("cls", "term"), plan.select("cls", "least", "rest").distinct()
    reached = join_counted(held.select("row", "term", "impact"), leads, "term", "inner", n_query).groupBy("cls", "row").agg(F.sum("impact").alias("score"))
    reached = join_counted(reached, bounds, "cls", "inner", n_query).where(F.col("score") + F.col("rest") >= F.col("least"))
    reached = scratch.put(reached.select("cls", "row", "score"), "reached")
    lacking = join_counted(held.select("row", "term", "impact"), reached.select("cls", "row"), "row", "inner", reached.count())
    others = join_counted(lacking, plan.where("not leads").select("cls", "term"), ["cls", "term"], "inner", n_query)
    scores = reached.unionByName(others.select("cls", "row", F.col("impact").alias("score"))).groupBy("cls", "row").agg(F.sum("score").alias("score"))
    scores = join_counted(scores.where("score > 0"), bounds, "cls", "inner", n_query).where(F.col("score") >= F.col("least")).select("cls", "row", "score")
    scores = scratch.put(scores, "scores")
    scores = join_counted(postings.where("term = ''").select("row", "doc_id"), scores, "row", "inner", scores.count())
    ranked = _best(scores, "cls", k, F.desc("score"), F.col("doc_id").asc_nulls_first(), F.col("row"))
    return classes.join(ranked, "cls").select("item_id", "rank", "doc_id", "score")
