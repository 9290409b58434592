"""The trie of conversation prefixes: nodes are distinct sequences of first turns.

Turns become digests with their lengths before anything else, so no text is kept. Conversations of equal turns are one
sequence, of which the least conv_id stands for all and their number is carried on. Sequences are dealt out by the digest
of their first turn into groups, each small enough for a task, where a trie of dictionaries is built and summed up in
postorder without recursion. First turns with more rows than ``limit`` are divided by the next turn, again and again,
and a sequence that is alone under its prefix needs no trie, however long it is. Nodes above the groups, the root among
them, are sums of what their children report.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curaspark.llm.common import Scratch, join_counted

#: Turns of a group that one task builds at a time.
LIMIT = 50_000
#: Most turns that a conversation takes over from the first one of its hundred.
TAKEN = 5
#: Of a node; up is the key of a parent outside the group, ends_at the sequence that ends here.
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_at", "up"]
NODE_SCHEMA = ", ".join(f"{c} long" for c in NODE[:-1]) + ", up string"
#: Of a turn in a group: the key of its trie and of the node above, the trie's depth, the sequence, how many
#: conversations it stands for and how many turns it has, and the turn.
COLUMNS = ["key", "up", "level", "seq", "copies", "n", "pos", "digest", "size"]
NONE = hashlib.sha256(b"").hexdigest()


def ordered(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, size) of all turns, pos 1 up: by turn, null first, then by the digest."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text), 256)
    rows = turns.where("conv_id IS NOT NULL").select("conv_id", "turn", digest.alias("digest"), F.length(text).cast("long").alias("size"))
    place = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return rows.select("conv_id", F.row_number().over(place).cast("long").alias("pos"), "digest", "size")


def rebuilt(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, size): h turns of the first conversation of the hundred, then one's own after the first h.

    Turnless conversations have one row with pos 0, no digest and no size."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (TAKEN + 1)
    base = F.col("conv_id") - F.col("conv_id") % 100
    convs = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")).withColumns({"h": h, "base": base})
    firsts = rows.where((F.col("pos") <= TAKEN) & (F.col("conv_id") % 100 == 0)).select(F.col("conv_id").alias("base"), "pos", "digest", "size")
    sizes = firsts.groupBy("base").agg(F.count(F.lit(1)).alias("there"))
    convs = convs.join(sizes, "base", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    taken = convs.join(firsts, "base").where(F.col("pos") <= F.col("h")).select("conv_id", "pos", "digest", "size")
    own = rows.join(convs.where(F.col("own") > F.col("h")).select("conv_id", "h", "taken"), "conv_id").where(F.col("pos") > F.col("h"))
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "size")
    empty = convs.where((F.col("taken") == 0) & (F.col("own") <= F.col("h"))).select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("size"))
    return taken.unionByName(own).unionByName(empty)


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each sequence's conv_ids, which come sorted; one running hash, so no list is held."""
    now, state = None, None
    for batch in batches:
        done = []
        for seq, ids in batch.groupby("seq", sort=False)["conv_id"]:
            text = ",".join(map(str, ids.tolist()))
            if seq == now:
                state.update(f",{text}".encode())
                continue
            if state:
                done.append((now, state.hexdigest()))
            now, state = seq, hashlib.sha256(text.encode())
        yield pd.DataFrame(done, columns=["ends_at", "ends_sha256"])
    if state:
        yield pd.DataFrame([(now, state.hexdigest())], columns=["ends_at", "ends_sha256"])


def sequences(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(seq, copies, n) of distinct sequences, their turns (seq, pos, digest, size), and (ends_at, ends_sha256)."""
    mark = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "pos", "digest"))
    each = rows.groupBy("conv_id").agg(F.count("digest").alias("n"), mark(1).alias("x"), mark(2).alias("y"), mark(3).alias("z"))
    each = scratch.put(each, "conversations")
    seqs = scratch.put(each.groupBy("n", "x", "y", "z").agg(F.min("conv_id").alias("seq"), F.count(F.lit(1)).alias("copies")), "sequences")
    lone = seqs.where("copies = 1").select(F.col("seq").alias("ends_at"), F.sha2(F.col("seq").cast("string").cast("binary"), 256).alias("ends_sha256"))
    many = each.join(seqs.where("copies > 1"), ["n", "x", "y", "z"]).select("seq", "conv_id")
    many = many.repartition("seq").sortWithinPartitions("seq", "conv_id").mapInPandas(_hashed, "ends_at long, ends_sha256 string")
    turns = rows.where("digest IS NOT NULL").join(seqs.select(F.col("seq").alias("conv_id")), "conv_id", "left_semi")
    turns = scratch.put(turns.withColumnRenamed("conv_id", "seq"), "turns")
    return seqs.select("seq", "copies", "n"), turns, scratch.put(lone.unionByName(many), "ends")


class _Node:
    __slots__ = ("seq", "copies", "size", "next", "ends_at", "leaves", "saved")

    def __init__(self, seq: int, size: int):
        self.seq, self.copies, self.size, self.next, self.ends_at, self.leaves, self.saved = seq, 0, size, {}, None, 0, 0


def _tries(group: pd.DataFrame) -> pd.DataFrame:
    """The nodes of a group of tries, one for each key."""
    tops: dict[str, tuple[_Node, str, int]] = {}
    held = None
    for key, up, level, seq, copies, n, pos, digest, size in group.sort_values(["key", "seq", "pos"])[COLUMNS].itertuples(index=False, name=None):
        if held == (key, seq):
            node = node.next.setdefault(digest, _Node(seq, size))
        else:  # the sequence's first turn here; all of a key share it
            node, held = tops.setdefault(key, (_Node(seq, size), up, level))[0], (key, seq)
        node.copies += copies
        if pos == n:
            node.ends_at = seq
    out = []
    for top, up, level in tops.values():
        stack = [(top, None, level, False)]
        while stack:
            node, parent, depth, seen = stack.pop()
            if not seen:
                stack.append((node, parent, depth, True))
                stack += [(child, node, depth + 1, False) for child in node.next.values()]
                continue
            node.leaves = sum(child.leaves for child in node.next.values()) or 1
            node.saved = (node.copies - 1) * node.size + sum(child.saved for child in node.next.values())
            out.append((node.seq, depth, parent.seq if parent else None, node.copies, len(node.next), node.leaves, node.saved, node.ends_at, None if parent else up))
    return pd.DataFrame(out, columns=NODE).astype({"parent_conv_id": "Int64", "ends_at": "Int64"})


def _alone(rows: DataFrame) -> DataFrame:
    """The nodes of sequences that are alone under their key: a path each."""
    after = Window.partitionBy("seq").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    top, last = F.col("pos") == F.col("level"), F.col("pos") == F.col("n")
    node = lambda saved: [
        F.col("seq").alias("conv_id"), F.col("pos").alias("depth"), F.when(~top, F.col("seq")).alias("parent_conv_id"), F.col("copies").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), saved.cast("long").alias("saved_tokens"),
        F.when(last, F.col("seq")).alias("ends_at"), F.when(top, F.col("up")).alias("up"),
    ]
    once, more = rows.where("copies = 1"), rows.where("copies > 1")
    return once.select(*node(F.lit(0))).unionByName(more.select(*node((F.col("copies") - 1) * F.sum("size").over(after))))


def prefix_trie(turns: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    turns (conv_id, turn, role, text); see ``rebuilt`` for what each conversation takes over. Null roles and texts are
    empty. Turns are ordered by turn, null first; turns of one number, repeated rows among them, all count and follow
    each other by the SHA-256 of role and text. Rows without a conv_id belong to no conversation and are left out, and so
    are other columns. Negative conv_ids round towards zero to their hundred. Without conversations there are no nodes.
    """
    spark, scratch = turns.sparkSession, Scratch(turns.sparkSession, "trie")
    rows = scratch.put(ordered(turns.select("conv_id", "turn", "role", "text")), "ordered")
    seqs, turns, ends = sequences(scratch.put(rebuilt(rows), "rebuilt"), scratch)

    # Down: what has more rows than a task should build is divided by the next turn.
    now, levels, level = seqs.withColumn("key", F.lit("")), [], 0
    opened = [spark.createDataFrame([("", None, 0)], "key string, up string, size long")]
    ended = [now.where("n = 0").select("key", F.col("seq").alias("ends_at"), "copies")]
    while True:
        level += 1
        turn = turns.where(F.col("pos") == level).select("seq", "digest", "size")
        below = now.where(F.col("n") >= level).withColumnRenamed("key", "up").join(turn, "seq")
        below = scratch.put(below.withColumn("key", F.sha2(F.concat("up", F.lit(":"), "digest"), 256)).drop("digest"), f"below{level}")
        sizes = scratch.put(below.groupBy("key").agg(F.count(F.lit(1)).alias("seqs"), F.sum(F.col("n") - level + 1).alias("rows")), f"sizes{level}")
        kind = F.when(F.col("seqs") == 1, "alone").when(F.col("rows") <= limit, "group").otherwise("open")
        held = join_counted(below, sizes, "key", "inner", sizes.count()).withColumn("kind", kind)
        held = scratch.put(held.withColumn("level", F.lit(level).cast("long")), f"level{level}")
        levels.append(held)
        now = held.where("kind = 'open'").select("seq", "copies", "n", "key", "up", "size")
        if now.isEmpty():
            break
        opened.append(now.groupBy("key").agg(F.min("up").alias("up"), F.min("size").alias("size")))
        ended.append(now.where(F.col("n") == level).select("key", F.col("seq").alias("ends_at"), "copies"))
        now = now.select("seq", "copies", "n", "key")

    # The groups, by task.
    dealt = levels[0]
    for held in levels[1:]:
        dealt = dealt.unionByName(held)
    dealt = dealt.where("kind <> 'open'").select("key", "up", "level", "seq", "copies", "n", "kind")
    dealt = scratch.put(dealt.join(turns, "seq").where(F.col("pos") >= F.col("level")), "dealt")
    grouped = dealt.where("kind = 'group'")
    parts = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-grouped.count() // limit))))
    nodes = grouped.select(*COLUMNS, parts.alias("part")).groupBy("part").applyInPandas(_tries, NODE_SCHEMA)
    nodes = scratch.put(nodes.unionByName(_alone(dealt.where("kind = 'alone'"))), "nodes")

    # Up: sums of what the children report.
    uppers = None
    for level in range(len(opened) - 1, -1, -1):
        report = nodes.where("up IS NOT NULL").where(F.col("depth") == level + 1)
        report = report.unionByName(above.drop("key")) if uppers is not None else report
        sums = report.groupBy("up").agg(*[f(c).alias(f"_{c}") for f, c in ((F.min, "conv_id"), (F.sum, "n_convs"), (F.count, "n_children"), (F.sum, "n_leaves"), (F.sum, "saved_tokens"))])
        held = opened[level].join(sums.withColumnRenamed("up", "key"), "key", "left").join(ended[level], "key", "left")
        number = lambda c: F.coalesce(c, F.lit(0))
        copies = number(F.col("_n_convs")) + number(F.col("copies"))
        above = held.select(
            F.least("_conv_id", "ends_at").alias("conv_id"), F.lit(level).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"),
            copies.alias("n_convs"), number(F.col("_n_children")).alias("n_children"), F.greatest(number(F.col("_n_leaves")), F.lit(1)).cast("long").alias("n_leaves"),
            (number(F.col("_saved_tokens")) + (copies - 1) * F.col("size")).alias("saved_tokens"), "ends_at", "up", "key",
        )
        above = scratch.put(above.where("n_convs > 0"), f"above{level}")
        uppers = above if uppers is None else uppers.unionByName(above)
    parents = uppers.select(F.col("key").alias("up"), F.col("conv_id").alias("parent"))
    all_ = join_counted(nodes.unionByName(uppers.drop("key")), parents, "up", "left", parents.count()).join(ends, "ends_at", "left")
    return all_.select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256"),
    )
