"""Line dedup: fuzzy lines by MinHash, with DataFrame and SQL functions only.

A line is compared lower-cased, its runs of blanks as one blank; lines of fewer than ``min_chars`` characters
then are never duplicates. A line is the set of 64-bit hashes of all its ``width``-character shingles (a shorter
one is a single shingle). Its MinHash signature is one permutation in ``BINS`` bins: the least hash of each bin.
Shingles are exploded into rows, where hashing stays in compiled code, and only those whose hash is small enough
to be a minimum (``RATE`` of a line in the mean) are gathered. A band is ``ROWS`` neighbouring bins, the last ones
next to the first. At a similarity of 0.8 two lines share a band in 98.7 of 100 cases, in more above it.

1. Equal lines collapse to one by a 128-bit hash; one occurrence, the first by (document, line number), leads.
2. Bands are counted with map-side combining; only bands of two or more different lines go on.
3. Every line is verified exactly against one other, the least line of most of its bands; links make components.
   Where a band still has two of them, each line is verified against one of the band drawn by a hash, and only in bands
   that are apart after that, each pair of different components in one of its bands; pairs whose 2,048-bit sketches
   are too far apart for the threshold are left out of both. So a band of many copies gives no pairs.
4. Distributed union-find over the links, then over links between components only; of each component the first line
   of the corpus stays.

Defined results: null text stays null; a null id keeps all its lines; rows that repeat an id and a text are one
document and lose the same lines; rows that repeat an id with another text count by themselves; empty lines and
short lines stay; an empty table gives an empty result; other columns are kept, but for columns called n_lines and
n_removed, which the results replace.
"""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curaspark.llm.common import BROADCAST_ROWS, Scratch, join_counted, let, spread
from curaspark.llm.components import components

WIDTH, PERCENT, MIN_CHARS = 8, 80, 24
BINS, ROWS, RATE = 12, 3, 48
#: Where both sides of a join are narrow, it shuffles from so many rows on: the driver builds small tables only, and what
#: is shuffled follows the input from small inputs on.
NARROW_ROWS = 20_000
ROW = ["doc_id", "text_hash"]


def normalised(text: Column) -> Column:
    """The text lower-cased, with each run of blanks within a line as one; blanks at the ends of lines are left to trim."""
    low = F.lower(text)
    # Many texts have single blanks only, which a search of bytes sees faster than a pattern.
    odd = reduce(or_, [F.contains(low, F.lit(x)) for x in ("  ", "\t", "\x0b", "\x0c", "\r")])
    return F.when(odd, F.regexp_replace(low, r"[\x20\x09\x0B-\x0D]+", " ")).otherwise(low)


def shingles(lines: DataFrame, width: int) -> DataFrame:
    """(k1, line) to (k1, n, h): the hash of each shingle, and how many there are. Of the UTF-32 bytes every four are a character."""
    n = F.greatest(F.length("line") - width + 1, F.lit(1))
    coded = lines.select("k1", n.alias("n"), F.encode("line", "UTF-32").alias("code"))  # below the explode, once a line
    rows = coded.select("k1", "n", "code", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("at"))
    return rows.select("k1", "n", F.xxhash64(F.substring(F.col("code"), F.col("at") * 4 + 1, F.lit(4 * width))).alias("h"))


def banded(lines: DataFrame, width: int) -> DataFrame:
    """(k1, line) to (k1, bands), null where too few bins are full: short lines leave bins empty; a band needs two that are not."""
    value, bin_ = F.shiftrightunsigned("h", 16), F.shiftright(F.col("h").bitwiseAND(F.lit(0xFFFF)) * BINS, 16)
    few = shingles(lines, width).where(value < F.lit(2.0**48 * RATE) / F.col("n")).select("k1", value.alias("value"), bin_.alias("bin"))
    least = few.groupBy("k1").agg(*[F.min(F.when(F.col("bin") == i, F.col("value"))).alias(f"m{i}") for i in range(BINS)])

    def band(i: int) -> Column:
        own = [F.col(f"m{(i + j) % BINS}") for j in range(ROWS)]
        full = sum((m.isNotNull().cast("int") for m in own), F.lit(0))
        return F.when(full >= ROWS - 1, F.xxhash64(F.lit(i), *own))

    return least.select("k1", F.array(*[band(i) for i in range(BINS)]).alias("bands"))


def line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row per line long enough: the row's identity, line_no, the normalised line, and its two hashes."""
    rows = docs.where("doc_id is not null and text is not null").select(*ROW, F.posexplode(F.split(normalised(F.col("text")), "\n", -1)).alias("line_no", "line"))
    rows = rows.select(*ROW, "line_no", F.trim("line").alias("line")).where(F.length("line") >= min_chars)
    return rows.withColumns({"k1": F.xxhash64("line"), "k2": F.xxhash64(F.lit(7), "line")})


#: Words of a sketch of 2,048 bits.
SKETCH = 32


def sketched(lines: DataFrame, width: int) -> DataFrame:
    """(k1, line) to k1, n, words and set: n shingles, repeated ones too, each of which sets one bit; how many are set."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("h", 58).cast("int"))
    rows = shingles(lines, width).select("k1", "n", F.col("h").bitwiseAND(F.lit(SKETCH - 1)).cast("int").alias("word"), bit.alias("bit"))
    # Each word by itself first: one aggregate a shingle, and then one row a word to lay out.
    rows = rows.groupBy("k1", "n", "word").agg(F.bit_or("bit").alias("bits"))
    words = [F.coalesce(F.bit_or(F.when(F.col("word") == i, F.col("bits"))), F.lit(0).cast("long")) for i in range(SKETCH)]
    laid = rows.groupBy("k1").agg(F.max("n").alias("n"), F.array(*words).alias("words"), F.sum(F.bit_count("bits")).cast("int").alias("set"))
    return laid.select("k1", "n", "words", "set")


def may_link(x: str, y: str, percent: int) -> Column:
    """Sets of a similarity t differ in at most (1 - t) / (1 + t) of their summed sizes, so in no more bits of their sketches.

    The size of a set lies between the bits it sets and its shingles with repeats. Words lie in arrays: as 64 columns
    they made one method too large for Java to compile, which then took some 30 microseconds a pair.
    """
    sizes = (100 * F.col(f"{x}.n") >= percent * F.col(f"{y}.set")) & (100 * F.col(f"{y}.n") >= percent * F.col(f"{x}.set"))
    bits = F.zip_with(F.col(f"{x}.words"), F.col(f"{y}.words"), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    unequal = F.aggregate(bits, F.lit(0), lambda so_far, n: so_far + n)
    return sizes & ((100 + percent) * unequal <= (100 - percent) * (F.col(f"{x}.n") + F.col(f"{y}.n")))


def likely(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose sketches leave it open that they link: no linking pair is lost."""
    ends = pairs.join(sketches.withColumnRenamed("k1", "a").alias("x"), "a").join(sketches.withColumnRenamed("k1", "b").alias("y"), "b")
    return ends.where(may_link("x", "y", percent)).select("a", "b")


def verify(pairs: DataFrame, lines: DataFrame, width: int, percent: int) -> DataFrame:
    """Those pairs (a, b) of lines(k1, line) whose sets of shingles are similar enough, by exact counts.

    Both texts of a pair are brought together once; their sets are made and compared within its row.
    """

    def hashes(code: Column) -> Column:
        last = F.greatest(F.octet_length(code) / 4 - width, F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.substring(code, i * 4 + 1, F.lit(4 * width))))

    left, right = (lines.select(F.col("k1").alias(c), F.col("line").alias(f"line_{c}")) for c in ("a", "b"))
    both = spread(pairs.join(left, "a").join(right, "b"), "a", "b")
    sides = F.struct(*[let(F.encode(f"line_{c}", "UTF-32"), hashes).alias(c) for c in ("a", "b")])
    near = let(sides, lambda s: 100 * F.size(F.array_intersect(s["a"], s["b"])) >= percent * F.size(F.array_union(s["a"], s["b"])))
    return both.where(near).select("a", "b")


def _placed(members: DataFrame, part: DataFrame) -> DataFrame:
    """(band, k1, component) of all lines in bands; a line without links is its own component."""
    held = members.select("band", "k1").join(part.withColumnRenamed("node", "k1"), "k1", "left")
    return held.withColumn("component", F.coalesce("component", "k1"))


def _merged(part: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """part(node, component) after more links(a, b): union-find over the components that these join, not over all lines."""
    left, right = (part.select(F.col("node").alias(c), F.col("component").alias(f"in_{c}")) for c in ("a", "b"))
    ends = links.join(left, "a", "left").join(right, "b", "left")
    over = components(ends.select(F.coalesce("in_a", "a").alias("a"), F.coalesce("in_b", "b").alias("b")), scratch, f"{name}_")
    over = scratch.put(over, f"{name}_over")
    moved = part.join(over.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    new = over.join(part.select("node"), "node", "left_anti")
    return scratch.put(moved.select("node", F.coalesce("to", "component").alias("component")).unionByName(new), name)


def repeated_lines(docs: DataFrame, scratch: Scratch, *, width=WIDTH, percent=PERCENT, min_chars=MIN_CHARS) -> DataFrame:
    """docs(doc_id, text_hash, text) to (doc_id, text_hash, line_no) of the lines to remove, without repeats."""
    lines = scratch.put(line_rows(docs, min_chars), "lines")
    at = F.struct("doc_id", "line_no", "text_hash")
    equal = lines.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("k1", "k2", F.lit(True).alias("equal"))
    equal = scratch.put(equal, "equal")

    in_bands = scratch.put(banded(lines.select("k1", "line"), width), "in_bands")
    in_bands = in_bands.select("k1", F.explode("bands").alias("band")).where("band is not null")
    # Bands of two or more different lines; a line is in a band once.
    shared = scratch.put(in_bands.groupBy("band").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("band"), "shared")
    members = scratch.put(join_counted(in_bands, shared, "band", "inner", shared.count(), NARROW_ROWS), "members")
    scratch.drop("in_bands")

    # From here on, one text for each line of a shared band.
    ids = scratch.put(members.select("k1").distinct(), "ids")
    texts = join_counted(lines.select("k1", "line"), ids, "k1", "left_semi", ids.count())
    texts = scratch.put(texts.groupBy("k1").agg(F.any_value("line").alias("line")), "texts")
    scratch.drop("ids")

    # Each line against the line it meets most often as the least of a band.
    least = members.groupBy("band").agg(F.min("k1").alias("least"))
    star = members.join(least, "band").where("least < k1").groupBy("k1", "least").agg(F.count(F.lit(1)).alias("times"))
    star = star.groupBy("k1").agg(F.max_by("least", F.struct("times", -F.col("least"))).alias("a")).select("a", F.col("k1").alias("b"))
    star = scratch.put(star, "star")
    # Pairs whose sketches differ in more bits than those of linking sets are not verified, here and below.
    sketches = scratch.put(sketched(spread(texts, "k1"), width), "sketched")
    one = scratch.put(verify(scratch.put(likely(star, sketches, percent), "likely1"), texts, width, percent), "links1")
    part = scratch.put(components(one, scratch, "cc1"), "part1")
    # Then each line against one more of its bands, drawn by a hash, where they are still apart.
    home = scratch.put(_placed(members, part), "home1")
    drawn = F.struct(F.xxhash64("k1", "band").alias("h"), "k1", "component")
    hubs = home.groupBy("band").agg(F.min(drawn).alias("hub"), F.min("component").alias("low"), F.max("component").alias("high"))
    hubs = scratch.put(hubs.where("low < high").select("band", F.col("hub.k1").alias("hub"), F.col("hub.component").alias("to")), "hubs")
    apart = home.join(hubs, "band")
    tried = apart.where("component <> to").select(F.least("k1", "hub").alias("a"), F.greatest("k1", "hub").alias("b")).distinct()
    tried = likely(tried.join(star, ["a", "b"], "left_anti"), sketches, percent)
    tried = scratch.put(tried, "tried")
    part = _merged(part, scratch.put(verify(tried, texts, width, percent), "links2"), scratch, "part2")
    # Last, what shares a band but no component even now; a pair with several bands meets in the least of them.
    home = scratch.put(_placed(members.join(hubs.select("band"), "band", "left_semi"), part), "home2")
    still = home.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("band")
    home = scratch.put(home.join(still, "band", "left_semi"), "home3")
    bands = scratch.put(home.groupBy("k1").agg(F.collect_set("band").alias("bands")), "bands")
    home = home.join(bands.join(sketches, "k1"), "k1")
    x, y = home.alias("x"), home.alias("y")
    meet = (F.col("x.band") == F.col("y.band")) & (F.col("x.k1") < F.col("y.k1")) & (F.col("x.component") != F.col("y.component")) & may_link("x", "y", percent)
    meet = meet & (F.array_min(F.array_intersect("x.bands", "y.bands")) == F.col("x.band"))
    cross = x.join(y, meet).select(F.col("x.k1").alias("a"), F.col("y.k1").alias("b")).join(star.unionByName(tried), ["a", "b"], "left_anti")
    two = scratch.put(verify(scratch.put(cross, "cross"), texts, width, percent), "links3")
    part = _merged(part, two, scratch, "part3")
    scratch.keep("lines", "equal", "part3")

    # One line a component, one occurrence a line.
    found = join_counted(lines.drop("line"), part.withColumnRenamed("node", "k1"), "k1", "left", part.count(), NARROW_ROWS)
    found = join_counted(found, equal, ["k1", "k2"], "left", equal.count(), NARROW_ROWS).where("component is not null or equal")
    alone = F.when(F.col("component").isNull(), F.col("k2"))
    found = scratch.put(found.select(at.alias("at"), F.coalesce("component", "k1").alias("component"), alone.alias("alone")), "found")
    keep = scratch.put(found.groupBy("component", "alone").agg(F.min("at").alias("keep")), "keep")
    same = (F.col("g.component") == F.col("h.component")) & F.col("g.alone").eqNullSafe(F.col("h.alone"))
    few = keep.count() <= NARROW_ROWS
    gone = found.alias("g").join((F.broadcast(keep) if few else keep).alias("h"), same).where("at <> keep")
    return gone.select("at.*").select(*ROW, "line_no").distinct()


def dedup_lines(docs: DataFrame, *, id="doc_id", text="text", **options) -> DataFrame:
    """All columns, with repeated lines cut from the text, and n_lines and n_removed."""
    scratch = Scratch(docs.sparkSession, "lines")
    named = docs.withColumns({"__lines_id": F.col(id).cast("long"), "__lines_hash": F.xxhash64(text)})
    rows = named.select(F.col("__lines_id").alias("doc_id"), F.col("__lines_hash").alias("text_hash"), F.col(text).alias("text"))
    removed = scratch.put(repeated_lines(rows, scratch, **options), "removed")
    ids = ["__lines_id", "__lines_hash"]
    removed = removed.groupBy(*[F.col(a).alias(b) for a, b in zip(ROW, ids)]).agg(F.collect_set("line_no").alias("__lines_removed"))
    removed = scratch.put(removed, "removed_by_row")
    scratch.keep("removed_by_row")  # the result reads no other
    n_rows = removed.count()
    if n_rows <= BROADCAST_ROWS:  # only texts that lose lines are shuffled
        hit = join_counted(named, removed.select(ids), ids, "left_semi", n_rows).join(removed, ids)
        rest = named.where("__lines_id is null").unionByName(join_counted(named.where("__lines_id is not null"), removed.select(ids), ids, "left_anti", n_rows))
        held = hit.unionByName(rest.withColumn("__lines_removed", F.lit(None).cast("array<int>")))
    else:
        held = named.join(removed, ids, "left")
    breaks = F.octet_length(text) - F.octet_length(F.replace(F.col(text), F.lit("\n")))
    held = held.withColumn("__lines_breaks", breaks)
    kept = F.array_except(F.sequence(F.lit(0), F.col("__lines_breaks")), "__lines_removed")
    left = let(F.split(text, "\n", -1), lambda all_: F.array_join(F.transform(kept, lambda i: all_[i]), "\n"))
    return held.withColumns(
        {
            text: F.when(F.col("__lines_removed").isNull(), F.col(text)).otherwise(left),
            "n_lines": F.when(F.col(text).isNotNull(), F.col("__lines_breaks") + 1).otherwise(0).cast("long"),
            "n_removed": F.coalesce(F.size("__lines_removed"), F.lit(0)).cast("long"),
        }
    ).drop("__lines_id", "__lines_hash", "__lines_removed", "__lines_breaks")
