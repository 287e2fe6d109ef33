"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, decontamination, fingerprints, jaccard, lines, lm_scoring, packing, pii, search, sharding, substrings, toxicity
from .common import table


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(table(spark, sf_dir, "documents"))


#: A conversation whose texts look like control strings, as one record of another layout than the table's rows.
MESSAGES = "array<struct<role: string, content: string>>"
CONTROL_RECORD = [(-7, 0, None, None, [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")])]


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.lit(None).cast(MESSAGES).alias("messages"))
    record = spark.createDataFrame(CONTROL_RECORD, f"conv_id long, turn long, role string, text string, messages {MESSAGES}")
    return chat.chat_digest(rows.union(record), messages_col="messages")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_digest(table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_digest(table(spark, sf_dir, "documents"), tokenizer_file())


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_components(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.personal_data_digest(docs, pii.train(docs))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_digest(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_fingerprints,
        op2_sharding,
        op3_chat_formatting,
        op4_substring_dedup,
        op5_lm_scoring,
        op6_line_dedup,
        op7_decontamination,
        op8_toxicity,
        op9_packing,
        op10_ngram_jaccard_join,
        op11_ranked_search,
        op12_personal_data,
        op13_token_alignment,
    )
}
OP3_SQL = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, length('<|turn|>' || replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;') || '<|text|>'
    || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;') || '</s>' || chr(10)) AS n
  FROM rows
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""
OP7_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT k FROM windows),
places AS (
  SELECT r, k, i, array_to_string(w[i : i + k - 1], ' ') AS win
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)
), hits AS (SELECT p.r, p.k, p.i, x.item_id FROM places p JOIN windows x ON p.k = x.k AND p.win = x.win),
words AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
#: Windows of 35 words that start at two places or more take their words with them.
OP4_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
places AS (SELECT r, i, array_to_string(w[i : i + 34], ' ') AS win FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
many AS (SELECT win FROM places GROUP BY win HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM places JOIN many USING (win)),
counts AS (SELECT r, count(*) AS n FROM gone GROUP BY r),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY j) AS text FROM words ANTI JOIN gone USING (r, j) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN counts USING (r) LEFT JOIN kept USING (r)
"""
#: All pairs that share a shingle, then reachability.
OP10_SQL = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), s AS (SELECT DISTINCT r, array_to_string(w[i : i + 2], ' ') AS x FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
pairs AS (SELECT a.r AS a, b.r AS b, count(*) AS common FROM s a JOIN s b ON a.x = b.x AND a.r <> b.r GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * common >= 90 * (x.n + y.n - common)),
reach(r, to_r) AS (SELECT r, r FROM d UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.to_r)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
FROM d JOIN reach USING (r) JOIN d o ON o.r = reach.to_r LEFT JOIN n ON n.r = d.r GROUP BY d.r, d.doc_id, n.n
"""
#: Every document that holds a term of the item, scored in full.
OP11_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), b AS (
  SELECT row_number() OVER () AS b, item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark
), q AS (SELECT b, item_id, term, count(*) AS times FROM (SELECT b, item_id, unnest(w) AS term FROM b) GROUP BY ALL),
totals AS (SELECT count(*) AS texts, CAST(sum(len(w)) AS BIGINT) AS total FROM d WHERE len(w) > 0),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(texts) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight FROM p, totals GROUP BY term),
m AS (SELECT r, doc_id, 75 + (25 * CAST(len(w) AS BIGINT) * texts) // total AS m FROM d, totals WHERE len(w) > 0),
scores AS (
  SELECT q.b, q.item_id, m.doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m.m))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN weights USING (term) JOIN m USING (r) GROUP BY q.b, q.item_id, m.r, m.doc_id
), ranked AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""
ORACLE_SQL: dict[str, str] = {"op3_chat_formatting": OP3_SQL, "op4_substring_dedup": OP4_SQL, "op7_decontamination": OP7_SQL, "op10_ngram_jaccard_join": OP10_SQL, "op11_ranked_search": OP11_SQL}
