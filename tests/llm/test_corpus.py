"""Operators over a whole corpus, against brute force: near duplicates, lines, repeats, language model, leaks, pipeline."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from curaspark.llm import components, decontaminate, lines, lm, near, repeats
from curaspark.llm.common import Scratch

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


class Groups:
    def __init__(self):
        self.of: dict = {}

    def find(self, x):
        self.of.setdefault(x, x)
        while self.of[x] != x:
            x = self.of[x]
        return x

    def join(self, x, y):
        x, y = sorted((self.find(x), self.find(y)))
        self.of[y] = x


def similar_pairs(sets: list[tuple[object, frozenset]]):
    index, met = defaultdict(list), []
    for a, (i, s) in enumerate(sets):
        shared = Counter(b for e in s for b in index[e])
        met += [(i, sets[b][0]) for b, n in shared.items() if 100 * n >= 80 * (len(s) + len(sets[b][1]) - n)]
        for e in s:
            index[e].append(a)
    return met


def shingles(text: str | None) -> frozenset:
    w = WORD.findall(lowered(text or ""))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def brute_near(rows) -> dict:
    groups = Groups()
    sets = [(r[0], shingles(r[1])) for r in rows if r[0] is not None]
    for i, _ in sets:
        groups.find(i)
    for a, b in similar_pairs(sets):
        groups.join(a, b)
    return {i: groups.find(i) for i, _ in sets}


@pytest.fixture(scope="module")
def families(spark):
    """Copies of texts with ever more words changed, of many sizes, so that similarities lie around the threshold."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(4))
    rows = []
    for size in (3, 6, 9, 12, 20, 33, 50, 64, 65, 90, 127, 129, 200, 300):
        base = [word() for _ in range(size)]
        for k in range(12):
            copy = list(base)
            for _ in range(k // 3):
                copy[rng.randrange(size)] = word()
            rows.append((len(rows), " ".join(copy)))
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def edited(rng: random.Random, words: list[str], times: int) -> list[str]:
    words = list(words)
    for _ in range(times):
        words[rng.randrange(len(words))] = "".join(rng.choice("nopqrstuvw") for _ in range(5))
    return words


def test_near_duplicates_of_large_groups(spark):
    """Groups of 90 near copies with similarities around the threshold, and texts that share most of a long passage."""
    rng = random.Random(23)
    text = lambda n: ["".join(rng.choice("abcdefghijklm") for _ in range(4)) for _ in range(n)]
    rows = []
    for size in (60, 130, 260):
        base = text(size)
        rows += [" ".join(edited(rng, base, rng.randint(0, size // 18))) for _ in range(90)]
    passage = text(150)
    rows += [" ".join(text(rng.randint(5, 60)) + passage + text(rng.randint(5, 60))) for _ in range(120)]
    rows = list(enumerate(rows))
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want = brute_near(rows)
    assert {r.doc_id: r.component_id for r in got} == want and 3 < len(set(want.values())) < 385


def test_near_duplicates(docs, families, odd, odd_rows, none):
    for rows, df in (families, ([(r.doc_id, r.text) for r in docs.collect()], docs), (odd_rows, odd)):
        want = brute_near(rows)
        got = near.near_duplicates(df).collect()
        assert len(got) == len(rows)
        assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
        assert sorted(r.n_shingles for r in got) == sorted(len(shingles(r[1])) for r in rows)
    assert near.near_duplicates(none).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in components.components(df, Scratch(spark, "test")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


def normal(line: str) -> str:
    return re.sub(r"[\x20\x09-\x0D]+", " ", line.lower()).strip(" ")


def line_set(line: str) -> frozenset:
    return frozenset(line[i : i + 8] for i in range(max(1, len(line) - 7)))


def brute_lines(rows) -> dict:
    """(id, text) to the text that stays."""
    groups, sets = Groups(), []
    for i, t in sorted({(r[0], r[1]) for r in rows if r[0] is not None and r[1] is not None}):
        for k, line in enumerate(t.split("\n")):
            if len(normal(line)) >= lines.MIN_CHARS:
                sets.append(((i, k, t), line_set(normal(line))))
    for a, b in similar_pairs(sets):
        groups.join(a, b)
    gone = {x for x, _ in sets if groups.find(x) != x}
    return {(r[0], r[1]): "\n".join(x for k, x in enumerate(r[1].split("\n")) if (r[0], k, r[1]) not in gone) if r[1] is not None else None for r in rows}


def test_lines(docs, odd, odd_rows, none):
    for rows, df in (([(r.doc_id, r.text) for r in docs.collect()], docs), ([r for r in odd_rows if r[0] != 4], odd.where("doc_id is null or doc_id <> 4"))):
        want = Counter((k[0], v) for k, v in brute_lines(rows).items())
        got = lines.dedup_lines(df)
        assert set((r[0], r[1]) for r in got.select("doc_id", "text").collect()) == set(want)
        assert got.count() == len(rows)
    held = lines.dedup_lines(odd)
    assert held.count() == odd.count() and set(odd.columns) <= set(held.columns)
    assert lines.dedup_lines(none).count() == 0


def test_recall_of_lines(spark):
    """Pairs of edited lines around the threshold: of those at 0.8 or more nine in ten are found, no other one goes."""
    rng, rows, near_by = random.Random(29), [], {}
    letter = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz     ")
    for k in range(1_500):
        line = "".join(letter() for _ in range(rng.randint(30, 400)))
        other = list(line)
        for _ in range(rng.randint(0, max(1, len(line) // 60))):
            other[rng.randrange(len(other))] = rng.choice("0123456789")
        rows += [(2 * k, line), (2 * k + 1, "".join(other))]
        x, y = line_set(normal(line)), line_set(normal(rows[-1][1]))
        near_by[2 * k + 1] = min(len(normal(line)), len(normal(rows[-1][1]))) >= 24 and 100 * len(x & y) >= 80 * len(x | y)
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).where("n_removed > 0")
    found = {r.doc_id for r in got.collect()}
    true = {i for i, near in near_by.items() if near}
    assert len(true) > 300 and found <= true and len(found) >= 0.97 * len(true)


def test_lines_by_all_shingles(spark, docs):
    """Brute force over all 8-character shingles of the lower-cased lines, their runs of blanks as one blank."""
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    more = ["see https://cdn.example.org/a/8347293847", "see https://cdn.example.org/a/1129384756", "A Heading  in Capitals of the Corpus", "a heading in capitals of the corpus"]
    rows += [(1_000_000 + i, x) for i, x in enumerate(more)]
    sets, groups = [], Groups()
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            line = re.sub(r"[\x20\x09-\x0D]+", " ", line.lower()).strip(" ")
            if len(line) >= 24:
                sets.append(((i, k), frozenset(line[j : j + 8] for j in range(len(line) - 7))))
    for a, b in similar_pairs(sets):
        groups.join(a, b)
    gone = {x for x, _ in sets if groups.find(x) != x}
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows}
    assert want[1_000_001] == more[1] and want[1_000_003] == ""
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == want


def test_pairs_of_lines_are_verified_in_their_rows(spark):
    """Against brute force, with repeated shingles and characters of several bytes, and without a row for each shingle."""
    rng = random.Random(3)
    base = "".join(rng.choice("abcdé日 ") for _ in range(150))
    held = [base, base + "x" * 30, base[:70] + "z" + base[71:], base[40:], "ab" * 60, "ab" * 90, "short", "😀" + base]
    pairs = [(a, b) for b in range(len(held)) for a in range(b)]
    got = lines.verify(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(list(enumerate(held)), "k1 long, line string"), 8, 80)
    sets = [line_set(x) for x in held]
    want = {(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert {tuple(r) for r in got.collect()} == want and 2 < len(want) < len(pairs)
    assert "Generate" not in got._jdf.queryExecution().toString()


def test_components_grow_by_links_between_them(spark):
    part = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5), (8, 8), (9, 8)], "node long, component long")
    links = spark.createDataFrame([(2, 6), (10, 11), (12, 9)], "a long, b long")
    got = {r.node: r.component for r in lines._merged(part, links, Scratch(spark, "test"), "p").collect()}
    assert got == {1: 1, 2: 1, 5: 1, 6: 1, 8: 8, 9: 8, 12: 8, 10: 10, 11: 10}


def brute_repeats(rows) -> dict:
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    first: dict[bytes, int] = {}
    for i, b in texts:
        for k in range(len(b) - 49):
            if i is not None:
                first[b[k : k + 50]] = min(first.get(b[k : k + 50], i), i)
    out = Counter()
    for i, b in texts:
        gone = [False] * len(b)
        for k in range(len(b) - 49):
            if i is not None and first[b[k : k + 50]] < i:
                gone[k : k + 50] = [True] * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_repeats(spark, docs, odd, odd_rows, none):
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    shared = [text(k) for k in (49, 50, 51, 80, 200)]
    rows = [(i, text(30) + rng.choice(shared) + text(40) + rng.choice(shared)) for i in range(40)] + [(50, shared[0]), (51, "z" * 300), (52, "z" * 120)]
    for rows, df in ((rows, spark.createDataFrame(rows, "doc_id long, text string")), ([(r.doc_id, r.text) for r in docs.collect()], docs), (odd_rows, odd)):
        got = Counter(tuple(r) for r in repeats.remove_repeats(df).collect())
        assert got == brute_repeats(rows)
    assert repeats.remove_repeats(none).count() == 0


def test_language_model(docs, odd, odd_rows, none):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    words = {i: WORD.findall(lowered(t)) for i, t in rows}
    uses, pairs = Counter(), Counter()
    for w in words.values():
        uses.update(w)
        uses[None] += bool(w)
        pairs.update(zip([None, *w], w))
    n = sum(c for w, c in uses.items() if w is not None)
    for r in lm.score(docs, slices=2).collect():
        w, total, known = words[r.doc_id], 0.0, 0
        for (v, x), c in Counter(zip([None, *w], w)).items():
            others = pairs[v, x] - c
            total += c * math.log(others / uses[v] if others else lm.BACKOFF * uses[x] / n)
            known += c * (others > 0)
        assert (r.n_words, r.n_known) == (len(w), known) and r.score == pytest.approx(total / len(w))
    held = lm.score(odd).collect()
    assert len(held) == len(odd_rows) and all(r.score is None for r in held if r.doc_id in (None, 0, 1, 2))
    assert lm.score(none).count() == 0


def plain(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lowered(text))


def test_leaks(spark, docs, odd, none):
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    items = {r.item_id: f" {' '.join(plain(r.text))} " for r in benchmark.collect()}
    exact = {(r.doc_id, i) for r in docs.collect() for i, t in items.items() if t in f" {' '.join(plain(r.text))} "}
    # Paraphrases: every fifth word exchanged, every ninth left out, inside other text.
    rng, rows, planted = random.Random(13), [], set()
    filler = next(r.text for r in docs.collect() if not any(d == r.doc_id for d, _ in exact) and len(r.text) > 1500)
    for k, (i, t) in enumerate(items.items()):
        w = ["other" if n % 5 == 2 else x for n, x in enumerate(t.split()) if n % 9 != 4]
        rows.append((100_000 + k, filler[:400] + " " + " ".join(w) + " " + filler[400:800], "en", "s", 0))
        planted.add((100_000 + k, i))
    df = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(df, benchmark).collect()}
    assert exact <= got and not {x for x in got - exact if x[0] < 100_000}
    assert len(got & planted) >= 0.9 * len(planted)
    assert decontaminate.find_leaks(odd, benchmark).count() == 0
    assert decontaminate.find_leaks(none, benchmark).count() == 0 and decontaminate.find_leaks(docs, benchmark.where("false")).count() == 0
    blank = spark.createDataFrame([(1, None), (2, " "), (None, "x y z")], "item_id long, text string")
    assert decontaminate.find_leaks(docs, blank).count() == 0


def test_leaks_of_many_passages(spark):
    """Verbatim items are found however many there are."""
    rng = random.Random(17)
    word = lambda: f"w{int(4000 * rng.random() ** 2)}"
    items = [(i, " ".join(word() for _ in range(rng.randint(15, 48)))) for i in range(2_100)]
    rows, planted = [], set()
    for d in range(0, len(items), 3):
        rows.append((d, " ".join(" ".join(word() for _ in range(40)) + " " + t for _, t in items[d : d + 3])))
        planted |= {(d, i) for i, _ in items[d : d + 3]}
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in got} >= planted


def test_leaks_of_all_item_rows(spark):
    """Every text of a repeated or null item id is searched, one passage of a long item is a leak, and a smaller cosine finds more."""
    rng = random.Random(19)
    text = lambda n: " ".join(f"w{rng.randrange(5_000)}" for _ in range(n))
    one, two, nameless, long = text(30), text(30), text(30), text(400)
    docs = [(i, f"{text(60)} {t} {text(60)}") for i, t in enumerate((one, two, nameless, " ".join(long.split()[:50])))] + [(9, text(200))]
    items = [(1, one), (1, two), (1, two), (None, nameless), (2, long)]
    df, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(df, benchmark).collect()} == {(0, 1), (1, 1), (2, None), (3, 2)}
    # Eight words of an item far apart, in order: too few for the usual cosine.
    thin = spark.createDataFrame([(5, " ".join(f"{text(9)} {w}" for w in one.split()[:8]))], df.schema)
    less = {"lcs": 0.05, "weak_lcs": 0.05}
    assert not decontaminate.find_leaks(thin.union(df.where("doc_id = 9")), benchmark, **less).where("doc_id = 5").count()
    assert decontaminate.find_leaks(thin.union(df.where("doc_id = 9")), benchmark, cosine=0.05, **less).where("doc_id = 5 and item_id = 1").count()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    scratch = Scratch(spark, "test_pipeline")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, scratch.put(stage(spark, docs, FOLDER), name)
        assert docs.columns == before.columns and 0 < docs.count() <= before.count(), name
        if name == "near_duplicates":
            left = brute_near([(r.doc_id, r.text) for r in before.collect()])
            assert {r.doc_id for r in docs.collect()} == set(left.values())
        if name == "line_dedup":
            want = brute_lines([(r.doc_id, r.text) for r in before.collect()])
            assert {(r.doc_id, r.text) for r in docs.collect()} == {(k[0], v) for k, v in want.items() if v == k[1] or v.strip()}
            assert all(r.n_chars == len(r.text) for r in docs.collect())
    assert {r.doc_id for r in corpus_pipeline.run(spark, FOLDER).collect()} == {r.doc_id for r in docs.collect()}


def test_pairs_of_a_text_are_told_apart_and_counted():
    keys = np.random.default_rng(1).integers(0, 50, 999).astype(np.uint64)
    at, uses = lm._distinct(keys)
    value, n = np.unique(keys, return_counts=True)
    assert (keys[at] == value).all() and (uses == n).all() and all(len(x) == 0 for x in lm._distinct(keys[:0]))
    words = lm.Words(pa.array(["", "a b", "", "", " ", "x\n y", "z", ""]))
    assert words.count.tolist() == [0, 2, 0, 0, 0, 2, 1, 0] and words.text.tolist() == [1, 1, 5, 5, 6]


def test_lines_and_near_duplicates_leave_what_their_results_read(spark):
    """Tables in the shared folder that no result reads any more are gone before the next stage begins."""
    rows = [(i, "\n".join(f"the line number {k // 3} of a text with some more words {k % 7}" for k in range(i, i + 9))) for i in range(30)]
    docs, root = spark.createDataFrame(rows, "doc_id long, text string"), Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"), "curaspark")
    for name, make, left in (("lines", lines.dedup_lines, {"removed_by_row"}), ("near", near.near_duplicates, {"sized", "home_of"})):
        before = set(root.glob(f"{name}-*"))
        got = make(docs)
        (new,) = set(root.glob(f"{name}-*")) - before
        assert {p.name for p in new.iterdir() if p.is_dir()} == left
        assert got.count() == 30


def test_sketches_leave_every_linking_pair(spark):
    rng, held = random.Random(5), []
    for _ in range(60):
        line = "".join(rng.choice("abcdefghij ") for _ in range(rng.randint(40, 900)))
        for edits in (0, len(line) // 90, len(line) // 40):
            other = list(line)
            for _ in range(edits):
                other[rng.randrange(len(other))] = "x"
            held.append("".join(other))
    rows = spark.createDataFrame(list(enumerate(held)), "k1 long, line string")
    pairs = [(a, b) for b in range(len(held)) for a in range(b)]
    sketches, sets = lines.sketched(rows, 8), [line_set(x) for x in held]
    got = {tuple(r) for r in lines.likely(spark.createDataFrame(pairs, "a long, b long"), sketches, 80).collect()}
    link = {(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert link and link <= got and len(got) < 0.05 * len(pairs)
    assert [c for c, t in sketches.dtypes if t == "array<bigint>"] == ["words"] and len(sketches.columns) == 4  # not a column a word
