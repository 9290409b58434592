"""String, path, template and word functions as expressions."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The phrase patterns, plain and informal.
PATTERNS = ["{}", "hey {}", "{} lütfen", "hey {} lütfen", "{}!", "hey {}!", "{}, lütfen", "hey {}, lütfen"]
INFORMAL = ["hey {} canım", "{} canım", "hey {} abla", "hey {} abi"]


def slug(text: Column) -> Column:
    return F.lower(F.translate(text, " ", "_"))


def dashed(name: Column) -> Column:
    return F.translate(F.lower(name), "_ ", "--")


def class_name(name: Column) -> Column:
    return F.replace(F.initcap(F.translate(name, "_-", "  ")), F.lit(" "), F.lit(""))


def output_name(text: Column, voice: Column, at: Column) -> Column:
    return F.concat(F.translate(text, " ", "_"), F.lit("_"), voice, F.lit("_"), F.unix_millis(at).cast("string"), F.lit(".wav"))


def truncated(text: Column, length: int = 30) -> Column:
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length - 3), F.lit("..."))).otherwise(text)


def tokens(text: Column) -> Column:
    """Lower-cased words; none for a blank text."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def distance(reference: Sequence[str], hypothesis: Sequence[str]) -> int:
    """Insertions, deletions and exchanges between two lists: a column of costs at a time, as bits of its steps up and down."""
    if not len(reference):
        return len(hypothesis)
    places: dict[str, int] = {}
    for i, w in enumerate(reference):
        places[w] = places.get(w, 0) | 1 << i
    full, last, cost = (1 << len(reference)) - 1, 1 << len(reference) - 1, len(reference)
    up, down = full, 0
    for w in hypothesis:
        same = places.get(w, 0)
        keeps = (((same & up) + up) ^ up) | same
        right, left = down | (full & ~(keeps | up)), up & keeps
        cost += bool(right & last) - bool(left & last)
        right, left = (right << 1 | 1) & full, left << 1 & full
        up, down = left | (full & ~(same | down | right)), right & (same | down)
    return cost


def edit_distance(reference: Column, hypothesis: Column) -> Column:
    """Between two arrays; null where one is null."""

    @F.pandas_udf("int")
    def apply(r: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else distance(x, y) for x, y in zip(r, h)], dtype="Int32")

    return apply(reference, hypothesis)


def word_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edits over the words of the reference; 1 for an empty reference; may exceed 1."""
    n = F.size(reference)
    return F.when(n == 0, F.lit(1.0)).otherwise(edit_distance(reference, hypothesis) / n)


def confidence(log_probs: Column) -> Column:
    """Mean of the logistic function of the segments' mean log probabilities; a half without segments."""
    n = F.size(log_probs)
    return F.when(n > 0, F.aggregate(log_probs, F.lit(0.0), lambda s, x: s + 1 / (1 + F.exp(-x))) / n).otherwise(F.lit(0.5))


def emphasised(text: Column, position: Column, mark: str = "*") -> Column:
    """The text with its word at a position marked; the plain text where there is no such word."""
    words = F.split(text, " ")
    marked = F.transform(words, lambda w, i: F.when(i == position, F.concat(F.lit(mark), w, F.lit(mark))).otherwise(w))
    return F.when(position < F.size(words), F.array_join(marked, " ")).otherwise(text)


def phrases(word: Column, informal: bool = True) -> Column:
    return F.array(*[F.replace(F.lit(p), F.lit("{}"), word) for p in PATTERNS + (INFORMAL if informal else [])])


def style_voice(voice: Column) -> Column:
    """struct<style, voice> of "style:voice"; a null style without a colon."""
    parts = F.split(voice, ":", 2)
    return F.struct(F.when(F.size(parts) == 2, parts[0]).alias("style"), F.element_at(parts, -1).alias("voice"))


def path_parts(path: Column) -> Column:
    """struct<name, stem, suffix, parent>."""
    name = F.substring_index(path, "/", -1)
    suffix = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    parent = F.regexp_replace(path, r"/?[^/]*$", "")
    return F.struct(name.alias("name"), F.substring(name, F.lit(1), F.length(name) - F.length(suffix)).alias("stem"), F.lower(suffix).alias("suffix"), parent.alias("parent"))


def with_environment(text: Column, values: dict[str, str]) -> Column:
    """``${NAME}`` and ``${NAME:default}`` replaced; null where a name has neither value nor default."""
    known = F.create_map(*[F.lit(x) for kv in values.items() for x in kv]) if values else F.create_map().cast("map<string,string>")
    pattern = r"\$\{(\w+)(?::([^}]*))?\}"
    names = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def value(found: Column) -> Column:
        name = F.regexp_extract(found, r"\$\{(\w+)", 1)
        default = F.when(found.contains(":"), F.regexp_extract(found, r":([^}]*)\}", 1))
        return F.coalesce(F.try_element_at(known, name), default)

    gaps = F.split(text, pattern, -1)
    filled = F.zip_with(gaps, F.concat(F.transform(names, value), F.array(F.lit(""))), lambda g, v: F.concat(g, v))
    return F.when(F.exists(filled, lambda x: x.isNull()), F.lit(None)).otherwise(F.array_join(filled, ""))


def display(values: Column) -> Column:
    """A map as "key: value" strings in the order of its keys."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(values)), lambda e: F.concat_ws(": ", e["key"], e["value"])), ", ")


def percent(share: Column, digits: int = 1) -> Column:
    """0.5 as 50.0%."""
    return F.format_string(f"%.{digits}f%%", share * 100)


def file_size(n_bytes: Column) -> Column:
    """In KB under a megabyte, in MB from there on."""
    return F.when(n_bytes < 1024 * 1024, F.format_string("%.1f KB", n_bytes / 1024)).otherwise(F.format_string("%.1f MB", n_bytes / (1024 * 1024)))


def with_defaults(defaults: Column, given: Column) -> Column:
    """One map with the keys of both; what is given counts."""
    return F.map_concat(F.map_filter(defaults, lambda k, _: ~F.map_contains_key(given, k)), given)


def from_base64(text: Column) -> Column:
    """The bytes; null where the text is no base 64."""
    return F.try_to_binary(text, F.lit("base64"))
