"""Dropout against a plain agenda, secrets with checksums, and odd, empty and clashing rows through every stage."""

from __future__ import annotations

import random
import re
import zlib

import corpus_pipeline
from curaspark.llm import pieces, queries, secrets
from curaspark.llm.common import Scratch

FOLDER = "/root/testdata/sf0.001"
M64 = 2**64 - 1


def mixed(h: int) -> int:
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & M64
    h = (h ^ h >> 27) * 0x94D049BB133111EB & M64
    return h ^ h >> 31


def plain_agenda(text: str, doc_id: int, dropout: float, seed: int, sp) -> list[int]:
    """The best-scored merge of two neighbours, the leftmost of equals, again and again, without those that are skipped."""
    known = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))}
    out = []
    spaced = "▁" + text.replace("▁", "\udc81").replace(" ", "▁")
    for k, word in enumerate(re.findall("▁*[^▁]+|▁+", spaced) if text else []):
        keyed = mixed(mixed(mixed((doc_id & M64) ^ mixed(seed)) + k & M64))

        def skipped(begin: int, middle: int, end: int) -> bool:
            place = ((begin * 0x1FFFF7 + middle) * 0x1FFFF7 + end) * 0x9E3779B97F4A7C15 & M64
            return mixed(keyed ^ place) < int(dropout * 2.0**64)

        cuts = list(range(len(word) + 1))
        while True:
            offers = [(-sp.get_score(known[p]), b, i) for i, (b, m, e) in enumerate(zip(cuts, cuts[1:], cuts[2:])) if (p := word[b:e]) in known and not skipped(b, m, e)]
            if not offers:
                break
            del cuts[min(offers)[2] + 1]
        for b, e in zip(cuts, cuts[1:]):
            piece = word[b:e]
            raw = piece.replace("\udc81", "▁").encode()
            out += [known[piece]] if piece in known else [sp.piece_to_id(f"<0x{x:02X}>") for x in raw]
    return out


def test_dropout_equals_a_plain_agenda(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    rng = random.Random(3)
    texts = ["internationalization of internationalization", "  two  blanks ", "", "é日本 ▁ own sign", "x" * 90, "a\nb\tc", "The quick brown fox jumps over the lazy dog."]
    texts += [" ".join("".join(rng.choices("etaoinshr", k=rng.randint(1, 14))) for _ in range(20)) for _ in range(10)]
    rows = [(i * 7 - 20, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    for dropout, seed in ((0.1, 1), (0.5, 9)):
        got = {r.doc_id: r.ids for r in pieces.encode(df, queries.PIECE_MODEL, dropout=dropout, seed=seed).collect()}
        assert got == {i: plain_agenda(t, i, dropout, seed, sp) for i, t in rows}


def checked(head: str, body: str) -> str:
    """A token whose last six characters are the base-62 CRC-32 of the thirty before."""
    digits, crc = "", zlib.crc32(body.encode())
    alphabet = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    for _ in range(6):
        crc, d = divmod(crc, 62)
        digits = alphabet[d] + digits
    return head + body + digits


def test_secrets_with_checksums(spark):
    rng = random.Random(6)
    body = lambda: "".join(rng.choices("ABCxyz0189", k=30))
    good = [checked(h, body()) for h in ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")]
    broken = [t[:-1] + ("A" if t[-1] != "A" else "B") for t in good]
    cards = ["4111 1111 1111 1111", "5500-0055-5555-5559", "378282246310005"]
    rows = [(i, f"é{t} tail") for i, t in enumerate(good)] + [(10 + i, t) for i, t in enumerate(broken)] + [(20, good[0] + "x"), (21, good[5] + "."), (22, "GHP_" + good[0][4:])]
    rows += [(30 + i, f"My card number: {c} ok") for i, c in enumerate(cards)] + [(40, "visa=4111111111111112"), (41, "visa=0000000000000000"), (42, f"number {cards[0]}"), (43, "VISA 4111111111111111 and Mastercard: 5500005555555559")]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(6)] == [[("npm" if i == 5 else "github", 1, 41)] for i in range(6)]
    assert all(got[10 + i] == [] for i in range(6)) and got[20] == got[22] == [] and got[21] == [("npm", 0, 40)]
    for i, c in enumerate(cards):
        assert got[30 + i] == [("card", 3, 16 + len(c))]
    assert got[40] == got[41] == got[42] == [] and [s[0] for s in got[43]] == ["card", "card"]


def test_stages_bear_odd_empty_and_clashing_rows(spark, odd, odd_rows, none):
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, FOLDER)
        rows = got.collect()
        if name == "tokens":
            assert got.columns == ["doc_id", "n_tokens", "ids"] and len(rows) == len(odd_rows) and all(len(r.ids) == r.n_tokens for r in rows)
        else:
            assert got.columns == odd.columns and len(rows) <= len(odd_rows), name
            assert {r.rank for r in rows} <= {"r", None} and {r.line for r in rows} <= {"l", None}  # other columns are kept
        if name in ("near_duplicates", "decontamination", "line_dedup"):
            assert sum(r.doc_id is None for r in rows) == 2, name
        assert stage(spark, none, FOLDER).count() == 0, name


def test_pipeline_of_odd_rows(spark, odd):
    docs, scratch = odd, Scratch(spark, "test_odd")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs.count(), scratch.put(stage(spark, docs, FOLDER), name)
        assert docs.count() <= before and docs.columns == odd.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() == docs.count()
