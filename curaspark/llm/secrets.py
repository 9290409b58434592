"""Secret scans: an Aho-Corasick pass over the text, anchored patterns only where it hits, then checksums.

Base kinds (fixed rules): ``assign``, ``access``, ``hex``; matches are leftmost and do not overlap within a kind.
Added kinds carry a checksum that must hold: ``github`` and ``npm`` tokens end in a base-62 CRC-32 of what
stands before it, ``card`` numbers near a card keyword pass the Luhn sum.

Defined results: null text is empty; offsets are code points of the whole text, end exclusive; repeated rows
each give a row; an empty table gives an empty result; other columns are ignored; a null id stays null.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curaspark.llm.near import _pieces

# The base patterns, and public formats of tokens that embed a checksum.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
GITHUB = re.compile(r"gh[pousr]_([0-9A-Za-z]{36})(?![0-9A-Za-z])")
NPM = re.compile(r"npm_([0-9A-Za-z]{36})(?![0-9A-Za-z])")
CARD = re.compile(r"(?:card|visa|mastercard)[a-z ]{0,12}[:=# ]{1,3}((?:[0-9][ -]?){12,18}[0-9])(?![0-9])", re.I | re.A)
KEYWORDS = {
    "assign": ["password", "passwd", "secret", "token", "apikey", "api_key"],
    "access": ["akia"],
    "github": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"],
    "npm": ["npm_"],
    "card": ["card", "visa"],
}
KINDS = ["assign", "access", "hex", "github", "npm", "card"]
MIN_VALUE, MIN_ACCESS, MIN_HEX = 8, 16, 32
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
SCHEMA = "doc_id long, kinds array<string>, starts array<int>, ends array<int>"


def crc_holds(value: str) -> bool:
    """The last six of a token's 36 characters are the base-62 CRC-32 of the first thirty."""
    crc, digits = zlib.crc32(value[:30].encode()), ""
    while crc:
        crc, d = divmod(crc, 62)
        digits = BASE62[d] + digits
    return digits.rjust(6, "0") == value[30:]


def luhn_holds(value: str) -> bool:
    digits = [int(c) for c in value if c.isdigit()]
    doubled = [d * 2 - 9 * (d > 4) if i % 2 else d for i, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0 and len(set(digits)) > 1


def accepted(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[2]) >= MIN_VALUE
    if kind == "access":
        return len(m[0]) >= MIN_ACCESS
    return luhn_holds(m[1]) if kind == "card" else crc_holds(m[1])


PATTERNS = {"assign": ASSIGN, "access": ACCESS, "github": GITHUB, "npm": NPM, "card": CARD}
IS_HEX = np.zeros(256, bool)
IS_HEX[list(b"0123456789abcdef")] = True


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            found.add_word(w, (kind, len(w)))
    found.make_automaton()
    return found


def hex_runs(raw: bytes) -> list[tuple[int, int]]:
    """Maximal runs of at least MIN_HEX hex digits, as byte offsets: every such run covers a probed byte."""
    data = np.frombuffer(raw, np.uint8)
    runs, done = [], 0
    for p in (np.flatnonzero(IS_HEX[data[MIN_HEX - 1 :: MIN_HEX]]) * MIN_HEX + MIN_HEX - 1).tolist():
        if p < done:
            continue
        start, end = p, p + 1
        while start > done and IS_HEX[data[start - 1]]:
            start -= 1
        while end < len(data) and IS_HEX[data[end]]:
            end += 1
        done = end
        if end - start >= MIN_HEX:
            runs.append((start, end))
    return runs


def scan_text(text: str, hits: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, order of kind, end) spans of one text, sorted."""
    raw = text.encode("utf-8", "surrogatepass")
    plain = len(raw) == len(text)
    lowered = raw.lower().decode("latin-1")  # one character a byte; only A-Z change
    spans, last = [], dict.fromkeys(PATTERNS, 0)
    near: list[tuple[int, str]] = sorted((end - n + 1, kind) for end, (kind, n) in hits.iter(lowered))
    runs = hex_runs(raw)
    if not near and not runs:
        return []
    if plain:
        point = lambda b: b
    else:
        before = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
        point = lambda b: int(before[b])
    for at, kind in near:
        start = point(at)
        if start < last[kind]:
            continue
        if m := PATTERNS[kind].match(text, start):
            last[kind] = m.end()
            if accepted(kind, m):
                spans.append((start, KINDS.index(kind), m.end()))
    spans += [(point(a), KINDS.index("hex"), point(b)) for a, b in runs]
    return sorted(spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hits = automaton()
    for batch in _pieces(batches):
        found = [scan_text(t, hits) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([[KINDS[k] for _, k, _ in f] for f in found], pa.list_(pa.string())),
                pa.array([[s for s, _, _ in f] for f in found], pa.list_(pa.int32())),
                pa.array([[e for _, _, e in f] for f in found], pa.list_(pa.int32())),
            ],
            ["doc_id", "kinds", "starts", "ends"],
        )


def scan_secrets(docs: DataFrame, *, id="doc_id", text="text") -> DataFrame:
    """One row per document: doc_id and spans array<struct<start,end,kind>>, by start, then kind."""
    picked = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = picked.mapInArrow(_scan, SCHEMA)
    span = F.transform(F.arrays_zip("starts", "ends", "kinds"), lambda s: F.struct(s["starts"].alias("start"), s["ends"].alias("end"), s["kinds"].alias("kind")))
    return found.select("doc_id", span.alias("spans"))
