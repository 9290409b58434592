"""Prefix trie, ranked search and token files, against brute force, plain encoders and SQL."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException

from curaspark.llm import queries, ranked, simple8b, tokenfiles, trie

TURNS = "conv_id long, turn long, role string, text string, pos string, digest long, key int, n string"
ITEMS = "item_id long, text string, term string, cls string, rank int"


def rounded(n: int) -> int:
    return n - int(math.fmod(n, 100))


def brute_trie(rows) -> set:
    convs = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).hexdigest()
            convs[conv].append((turn is not None, turn, digest, role, text))
    convs = {c: [t[3:] for t in sorted(turns)] for c, turns in convs.items()}
    built = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = convs.get(rounded(c), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in sorted(built.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    saved = lambda k: (len(members[k]) - 1) * len(k[-1][1]) if k else 0
    below = lambda k: [x for x in members if x[: len(k)] == k]
    children = {k: [x for x in below(k) if len(x) == len(k) + 1] for k in members}
    return {
        (
            held[0], len(k), members[k[:-1]][0] if k else None, len(held), len(children[k]), sum(not children[x] for x in below(k)), sum(map(saved, below(k))),
            hashlib.sha256(",".join(str(c) for c in held if len(built[c]) == len(k)).encode()).hexdigest(),
        )
        for k, held in members.items()
    }


def some_turns(rng: random.Random, convs: list[int]) -> list[tuple]:
    rows = []
    for c in convs:
        path = []
        for t in range(rng.choice([1, 2, 3, 5, 8])):
            path.append(rng.choice("abc" if t < 2 else "abcdef") * rng.randint(1, 2))
            rows.append((c, t, ("user", "assistant")[t % 2], path[-1], "p", 1, 2, "n"))
    return rows


@pytest.mark.parametrize("limit", [1, 12, 50_000])
def test_trie_with_tries_divided_by_ever_later_turns(spark, limit):
    rng = random.Random(4)
    rows = some_turns(rng, [*range(-130, 160, 3), *range(1000, 1060)])
    rows += [(c, t, "user", "same", "p", 1, 2, "n") for c in range(5000, 5040) for t in range(9)]  # copies
    rows += [(7000, t, "user", f"turn {t}", "p", 1, 2, "n") for t in range(300)]  # one long conversation
    got = trie.prefix_trie(spark.createDataFrame(rows, TURNS).repartition(3), limit=limit).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute_trie(rows)


def test_trie_of_odd_rows(spark):
    rows = [
        (None, 0, "user", "no conversation"), (1, None, "user", "first"), (1, 3, None, None), (1, 3, "user", "tie"), (1, 3, "user", "tie"), (2, 0, "user", ""),
        (3, 0, "user", "x" * 60_000), (100, 0, "user", "é\0日本"), (104, 1, "", "only one turn, so it may vanish"), (-7, 0, "user", "minus"), (-207, 5, "user", "minus"),
    ]
    rows += [(200 + i, 0, "user", "alone") for i in range(1, 12)]  # turnless where h is more than 0: no first conversation
    rows = [(*r, "p", 1, 2, "n") for r in rows]
    assert {tuple(r) for r in trie.prefix_trie(spark.createDataFrame(rows, TURNS)).collect()} == brute_trie(rows)
    only = [(201, 0, "user", "gone", "p", 1, 2, "n")]
    assert zlib.crc32(b"201") % 6 and [tuple(r) for r in trie.prefix_trie(spark.createDataFrame(only, TURNS)).collect()] == [*brute_trie(only)]
    assert trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0


def brute_search(items, docs, k: int) -> set:
    terms = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), s or ""))
    held = [(i, Counter(terms(t))) for i, t, *_ in docs]
    total = sum(c.total() for _, c in held)
    n_docs, df = sum(bool(c) for _, c in held), Counter(t for _, c in held for t in c)
    asked = defaultdict(set)
    for i, t, *_ in items:
        asked[i] |= set(terms(t))
    out = set()
    for item, words in asked.items():
        scores = []
        for i, c in held:
            m = 10 + 90 * c.total() * n_docs // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in words if c[t])
            scores += [(-score, i is not None, i)] * (score > 0)
        out |= {(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores)[:k], 1)}
    return out


@pytest.mark.parametrize("k", [1, 3, 10])
def test_search_prunes_nothing_that_ranks(spark, k):
    """Frequent and rare terms, copies with equal scores, terms that a third of the documents hold, repeated items."""
    rng = random.Random(k)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(300)]
    docs += [(300 + i, docs[i % 7][1]) for i in range(150)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 25))), "t", "c", 1) for i in range(25)]
    items += [(25 + i, items[i][1], "t", "c", 1) for i in range(5)] + [(0, "w1 w2 w90", "t", "c", 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = ranked.search(spark.createDataFrame(items, ITEMS), frame, k).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute_search(items, docs, k)


def test_search_without_broadcast(spark, docs, monkeypatch):
    held = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(i, t[200:420], "t", "c", 1) for i, t in held[:40:4]]
    monkeypatch.setattr(ranked, "BROADCAST_BYTES", 0)
    monkeypatch.setattr("curaspark.llm.common.BROADCAST_ROWS", 0)
    got = ranked.search(spark.createDataFrame(items, ITEMS), docs).collect()
    assert {tuple(r) for r in got} == brute_search(items, held, 10)


def test_search_of_odd_rows(spark, odd, odd_rows, none):
    items = [(1, "x" * 50_000, "t", "c", 1), (2, None, "t", "c", 1), (3, "  ", "t", "c", 1), (None, "日本語 ONE", "t", "c", 1), (None, "changed", "t", "c", 1), (4, "absent", "t", "c", 1), (5, odd_rows[4][1], "t", "c", 1)]
    asked = spark.createDataFrame(items, ITEMS)
    got = ranked.search(asked, odd).collect()
    count = lambda rows: Counter((r[0], r[1], r[3]) for r in rows)  # noqa: E731  repeated ids tie
    assert count(map(tuple, got)) == count(brute_search(items, odd_rows, 10)) and any(r[0] is None for r in got)
    assert ranked.search(asked, none).count() == 0 and ranked.search(asked.limit(0), odd).count() == 0


def plain_selectors(values: list[int]) -> list[int]:
    out, i = [], 0
    while i < len(values):
        fits = (s for s, (c, w) in enumerate(zip(simple8b.COUNTS, simple8b.WIDTHS)) if c == 1 or all(v < 2 ** int(w) for v in values[i : i + c]))
        out.append(next(fits))
        i += simple8b.COUNTS[out[-1]]
    return out


def test_blocks_hold_what_a_plain_greedy_walk_packs():
    rng = np.random.default_rng(1)
    held = [
        np.zeros(0), np.zeros(1), np.zeros(1000), np.full(5000, 2**64 - 1, np.uint64), np.array([2**60 - 2, 2**60 - 1, 2**60, 0, 1], np.uint64), rng.integers(0, 50_257, 30_000),
        np.repeat(rng.integers(0, 2, 300), rng.integers(1, 400, 300)), 2 ** rng.integers(0, 63, 20_000) - rng.integers(0, 2, 20_000), rng.integers(0, 2**63, 9000).astype(np.uint64) * 2 + 1,
    ]
    for values in held:
        values = values.astype(np.uint64)
        packed = simple8b.pack(values)
        assert np.array_equal(simple8b.unpack(packed), values)
        words, at = (packed.words >> np.uint64(60)).tolist(), 0
        for i, n in enumerate(packed.n_words):
            assert words[at : at + n] == plain_selectors(values[i * simple8b.BLOCK : (i + 1) * simple8b.BLOCK].tolist())
            at += n


def plain_ids(texts):
    from tokenizers import Tokenizer

    held = Tokenizer.from_file(queries.BYTE_MODEL)
    return [held.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_encoder_equals_the_library_on_whole_texts():
    rng = random.Random(2)
    marks = [" ", "  ", "\n", " \n ", "\t", " ", "　", " ", "\x1f", "\x85", "​", "'s", "'", "a", "Bc", "é", "日", "1", "12", ".", "!?", "<|endoftext|>", "👍🏽", "́", "\0", "ſ"]
    texts = ["".join(rng.choices(marks, k=rng.randint(0, 40))) for _ in range(3000)] + [None, "", " ", "a" * 5000, "word " * 3000]
    encoder, want = tokenfiles.Encoder(queries.BYTE_MODEL), plain_ids(texts)
    for some in (slice(None), slice(5), slice(0), slice(2990, None)):  # the second time most pieces are known
        ids, sizes = encoder.encode(pa.array(texts[some], pa.string()), 0)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes))][:-1] == [ids + [0] for ids in want[some]]
    ids, sizes = encoder.encode(pa.array(texts, pa.string()), None)
    assert ids.tolist() == [i for x in want for i in x] and sizes.tolist() == [len(x) for x in want]


def brute_files(rows, order) -> list:
    out, start = [], 0
    for (doc, *_), ids in zip(rows, plain_ids(r[1] for r in rows)):
        ids = ids + [0]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files(spark, docs, odd, odd_rows, none, tmp_path, monkeypatch):
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    monkeypatch.setattr(tokenfiles, "AT_ONCE", simple8b.BLOCK)  # the driver's part; workers keep theirs
    folder = f"file://{tmp_path}/docs"
    tokenfiles.write_texts(docs.repartition(3), folder, queries.BYTE_MODEL)
    held = tokenfiles.read_ids(spark, folder)
    want = brute_files(rows, None)
    assert sorted(map(tuple, tokenfiles.digests(held).collect())) == want
    all_ids = [i for ids in plain_ids(t for _, t in rows) for i in [*ids, 0]]
    assert [r.ids for r in held.orderBy("doc_id").collect()][3] == all_ids[want[3][1] : want[3][1] + want[3][2]]
    again = tokenfiles.tokenize(tokenfiles.ordered(docs), queries.BYTE_MODEL, None)
    assert [(r.doc_id, [*r.ids, 0]) for r in again.orderBy("doc_id").collect()] == [(r.doc_id, r.ids) for r in held.orderBy("doc_id").collect()]
    for a, b in ((0, 1), (8190, 8200), (20_000, 60_000), (len(all_ids) - 5, len(all_ids)), (7, 7)):
        assert tokenfiles.ids_between(folder, a, b).tolist() == all_ids[a:b]
    tokenfiles.write_texts(odd, folder, queries.BYTE_MODEL)  # another table in its place
    got = tokenfiles.digests(tokenfiles.read_ids(spark, folder)).collect()
    assert Counter((r[0], r[2], r[3]) for r in got) == Counter((r[0], r[2], r[3]) for r in brute_files(odd_rows, None))
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == sorted((r.doc_id for r in got), key=lambda i: (i is not None, i))
    assert [r.start for r in ordered] == [sum(r.n_tokens for r in ordered[:i]) for i in range(len(ordered))]
    tokenfiles.write_ids(tokenfiles.tokenize(tokenfiles.ordered(none), queries.BYTE_MODEL), folder)
    assert tokenfiles.read_ids(spark, folder).count() == 0 and not list(tmp_path.glob("docs/*.s8b"))


def test_failed_and_repeated_writes_leave_no_file_of_theirs(spark, tmp_path):
    folder, schema = f"file://{tmp_path}/ids", "doc_id bigint, ids array<bigint>"
    tokenfiles.write_ids(spark.createDataFrame([(-5, [2**62, 0, 7]), (2**62, [])], schema).coalesce(1), folder)
    with pytest.raises(PySparkException, match="come first"):
        tokenfiles.write_ids(spark.createDataFrame([(1, [5]), (None, [6])], schema).coalesce(1), folder)
    assert len(list(tmp_path.glob("ids/*.s8b"))) == 1
    assert [tuple(r) for r in tokenfiles.read_ids(spark, folder).collect()] == [(-5, 0, 3, [2**62, 0, 7]), (2**62, 3, 0, [])]
    tokenfiles.write_ids(spark.createDataFrame([(1, [5])], schema).coalesce(1), folder)
    assert len(list(tmp_path.glob("ids/*.s8b"))) == 1 and tokenfiles.ids_between(folder, 0, 9).tolist() == [5]
    with pytest.raises(PySparkException, match="as a whole"):
        spark.createDataFrame([(1, [5])], schema).write.format("token_ids").mode("append").save(folder)
