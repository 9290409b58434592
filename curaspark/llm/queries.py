"""The registered queries of the operators in this folder, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curaspark.llm import chat, decontaminate, lines, lm, near, pieces, pii, quality, ranked, repeats, secrets, tokenfiles, trie
from curaspark.llm.common import Scratch, documents


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "\\### Assistant: </turn> ok"
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], turns.schema))
    chats = chat.format_chats(turns).withColumn("back", chat.parse_chats(F.col("formatted")))
    loss = chat.loss_text(F.col("formatted"), F.col("loss_spans"))
    lines = F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return chats.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), n AS (
  SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after,
         row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS c,
         length(text) + length(text) - length(replace(text, '\', ''))
           + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0)
           + (length(text) - length(replace(text, '</turn>', ''))) // 7
           + (length(text) - length(replace(text, '<next/>', ''))) // 7 AS body
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(body + CASE WHEN k = 1 OR before <> role THEN 6 + length(role) ELSE 7 END
                + CASE WHEN k = c OR after <> role THEN 8 ELSE 0 END)::BIGINT AS formatted_chars
FROM n GROUP BY conv_id
"""


#: The merge-type model with byte fallback among the public tokenizers; the folder is a parameter of the deployment.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"

#: The key of the registered query; a deployment passes its own.
PII_KEY = "registered-query"


def op2_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_private long, private_kinds array<string>, text with the pseudonyms."""
    held = pii.pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), key=PII_KEY)
    return held.select("doc_id", F.size("private_kinds").cast("long").alias("n_private"), "private_kinds", "text")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(documents(spark, sf_dir))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans")
    )


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(documents(spark, sf_dir))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids (with dropout), decoded_sha256 (of the text read back from them)."""
    held = pieces.decode(pieces.encode(documents(spark, sf_dir), PIECE_MODEL), PIECE_MODEL)
    return held.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("text", 256).alias("decoded_sha256"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_words, n_known, score (rounded to 6 places)."""
    return lm.score(documents(spark, sf_dir)).withColumn("score", F.round("score", 6))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold benchmark items: doc_id, item_id, cosine, lcs, answers (rounded to 4 places)."""
    leaks = decontaminate.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return leaks.select("doc_id", "item_id", *[F.round(c, 4).alias(c) for c in ("cosine", "lcs", "answers")])


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, kept_sha256 (of the text that stays)."""
    held = lines.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return held.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.apply_quality_rules(documents(spark, sf_dir))
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept", "distance")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(documents(spark, sf_dir))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), documents(spark, sf_dir))


#: The byte-level vocabulary among the public tokenizers.
BYTE_MODEL = "/opt/tokenizers/byte_bpe_50k.json"


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32, read back from the files."""
    folder = f"{Scratch(spark, 'token_files').root}/ids"
    tokenfiles.write_texts(documents(spark, sf_dir), folder, BYTE_MODEL)
    return tokenfiles.digests(tokenfiles.read_ids(spark, folder))


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPLIT = rf"list_filter(regexp_split_to_array({LOWERED}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
OP4_SQL = f"""
WITH RECURSIVE t AS (SELECT doc_id, {SPLIT} AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s FROM t),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k, any_value(x.n + y.n) AS n FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * k >= 80 * (n - k)),
r(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, (SELECT min(b) FROM r WHERE r.a = s.doc_id) AS component_id FROM s
"""
OP6_SQL = f"""
WITH t AS (SELECT doc_id, {SPLIT} AS w FROM documents),
p AS (SELECT doc_id, unnest(list_concat([''], w[1 : len(w) - 1])) AS v, unnest(w) AS x FROM t WHERE len(w) > 0),
d AS (SELECT doc_id, v, x, count(*) AS uses FROM p GROUP BY ALL),
g AS (SELECT v, x, sum(uses) AS total FROM d GROUP BY ALL),
u AS (SELECT x, count(*) AS total FROM p GROUP BY x UNION ALL SELECT '', count(*) FROM t WHERE len(w) > 0),
m AS (SELECT d.doc_id, d.uses, g.total - d.uses AS others,
             CASE WHEN g.total > d.uses THEN ln((g.total - d.uses) / c.total) ELSE ln({lm.BACKOFF} * b.total / (SELECT count(*) FROM p)) END AS value
      FROM d JOIN g USING (v, x) JOIN u c ON c.x = d.v JOIN u b ON b.x = d.x),
z AS (SELECT doc_id, sum(uses) AS n, sum(uses) FILTER (others > 0) AS k, sum(uses * value) / sum(uses) AS score FROM m GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(k, 0)::BIGINT AS n_known, round(score, 6) AS score FROM t LEFT JOIN z USING (doc_id)
"""


# crc32 bit by bit: a byte is xored in, then eight shifts follow (marked -1). A node's key is the chain of its turns' hashes.
OP11_SQL = """
WITH RECURSIVE t AS (
  SELECT conv_id, sha256(length(r)::VARCHAR || ':' || r || ':' || x) AS d, length(x) AS size,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(r)::VARCHAR || ':' || r || ':' || x)) AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)
), c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT,
           flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda b: [ascii(b)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT c.conv_id, t.d, t.size, pos FROM c JOIN t ON t.conv_id = c.base AND t.pos <= h
  UNION ALL SELECT c.conv_id, t.d, t.size, pos + 1000000 FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > h
), n AS (
  SELECT conv_id, d, size, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth FROM r
), k AS (
  SELECT conv_id, 0::BIGINT AS depth, '' AS key, '' AS up, 0::BIGINT AS size FROM c
  UNION ALL SELECT k.conv_id, n.depth, sha256(k.key || ':' || n.d), k.key, n.size FROM k JOIN n ON n.conv_id = k.conv_id AND n.depth = k.depth + 1
), m AS (
  SELECT key, any_value(up) AS up, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS own FROM k GROUP BY key
), e AS (
  SELECT key, conv_id FROM (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS last FROM k) WHERE depth = last
), h AS (
  SELECT key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM e GROUP BY key
), ch AS (SELECT up AS key, count(*) AS n_children FROM m WHERE depth > 0 GROUP BY up),
a AS (
  SELECT x.key, sum(y.own)::BIGINT AS saved, count(*) FILTER (ch.n_children IS NULL) AS leaves
  FROM k x JOIN m y ON y.conv_id = x.conv_id AND y.depth >= x.depth LEFT JOIN ch ON ch.key = y.key GROUP BY x.key
)
SELECT m.conv_id, m.depth, p.conv_id AS parent_conv_id, m.n_convs, coalesce(ch.n_children, 0)::BIGINT AS n_children,
       a.leaves::BIGINT AS n_leaves, a.saved AS saved_tokens, coalesce(h.ends, sha256('')) AS ends_sha256
FROM m JOIN a USING (key) LEFT JOIN m p ON p.key = m.up AND m.depth > 0 LEFT JOIN ch ON ch.key = m.key LEFT JOIN h ON h.key = m.key
"""
FOUND = rf"regexp_extract_all({LOWERED}, '{ranked.TERM}')"
OP12_SQL = f"""
WITH d AS (SELECT doc_id, {FOUND} AS t FROM documents),
s AS (SELECT count(*) FILTER (len(t) > 0) AS n, sum(len(t))::BIGINT AS l FROM d),
o AS (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM o GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * (SELECT n FROM s) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p GROUP BY term),
i AS (SELECT DISTINCT item_id, unnest({FOUND}) AS term FROM benchmark),
x AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * p.n * s.n) // s.l))))::BIGINT AS score
      FROM i JOIN p USING (term) JOIN w USING (term), s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_format": op1_chat_format,
        "op2_pii_pseudonyms": op2_pii_pseudonyms,
        "op3_secret_scan": op3_secret_scan,
        "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_lm_score": op6_lm_score,
        "op7_decontaminate": op7_decontaminate,
        "op8_line_dedup": op8_line_dedup,
        "op9_quality_rules": op9_quality_rules,
        "op10_suffix_array_dedup": op10_suffix_array_dedup,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_ranked_search": op12_ranked_search,
        "op13_token_files": op13_token_files,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": OP1_SQL, "op4_ngram_jaccard_join": OP4_SQL, "op6_lm_score": OP6_SQL, "op11_prefix_trie": OP11_SQL, "op12_ranked_search": OP12_SQL}
