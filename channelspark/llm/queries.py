"""One registered query per operator, over its whole table and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from channelspark.llm import (
    attention_lm, bpe, conversation_repair, language, line_dedup, mixing, simhash, token_alignment, token_counts, top_k,
    toxicity, vector_dedup, wrappers,
)
from channelspark.llm.common import remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


LINES_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, ls[pos] AS line
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.doc_id, k.pos, k.line, (r.key IS NOT NULL AND k.doc_id <> r.keeper) AS dropped
  FROM keyed k LEFT JOIN repeated r ON k.key = r.key AND length(k.key) >= 20
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN dropped THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN dropped THEN NULL ELSE line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op2_line_dedup", LINES_SQL)
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return line_dedup.drop_repeated_lines(table(spark, sf, "documents")).select(
        "row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256")
    )


@query("op5_simhash_near_dedup")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents")).select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


@query("op6_bpe")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf, "documents")).select(
        "row.doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op7_toxicity")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = toxicity.fit(docs, labels.where(remainder(F.col("doc_id"), 5) != 0))
    return toxicity.score_documents(docs, model).select(
        "row.doc_id",
        (remainder(F.col("row.doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


MIX_LIMIT = 1.25
MIX_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, CAST(doc_id AS VARCHAR) AS key,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens,
         substr(md5('7:b:' || CAST(doc_id AS VARCHAR)), 1, 3) AS block
  FROM documents
), sums AS (SELECT source, CAST(sum(tokens) AS BIGINT) AS t FROM docs GROUP BY source),
total AS (SELECT CAST(sum(t) AS DOUBLE) AS b FROM sums),
powers AS (SELECT source, t, k, pow(CAST(t AS DOUBLE), k / 4096.0) AS p FROM sums, range(0, 4097) g(k) WHERE t > 0),
totals AS (SELECT k, sum(p) AS total, max(p / t) AS most FROM powers GROUP BY k),
best AS (SELECT coalesce(min(k), 4096) AS k FROM totals, total WHERE b * most / total <= LIMIT),
want AS (
  SELECT p.source, p.t, CAST(floor(p.p * b / totals.total + 1e-6) AS BIGINT) AS want
  FROM powers p JOIN totals USING (k) JOIN best USING (k), total
), plan AS (
  SELECT s.source, CASE WHEN s.t > 0 THEN want // s.t ELSE 1 END AS whole, CASE WHEN s.t > 0 THEN want % s.t ELSE 0 END AS rest
  FROM sums s LEFT JOIN want w ON s.source IS NOT DISTINCT FROM w.source
), last AS (
  SELECT d.*, whole, rest, sum(tokens) OVER (PARTITION BY d.source ORDER BY md5('7:' || (whole + 1) || ':' || block),
         md5('7:' || (whole + 1) || ':' || key), key) AS upto
  FROM docs d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
), copies AS (SELECT *, whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS n FROM last)
SELECT doc_id, source, tokens, epoch, block, md5('7:' || epoch || ':' || block) || ':' || md5('7:' || epoch || ':' || key) AS place
FROM (SELECT *, unnest(range(1, n + 1)) AS epoch FROM copies)
""".replace("LIMIT", str(MIX_LIMIT))


@query("op10_source_mixing", MIX_SQL)
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf, "documents"), budget="corpus", repeat_limit=MIX_LIMIT).select(
        "row.doc_id", "row.source", "tokens", "epoch", "block", "place"
    )


@query("op1_token_counts")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf, "documents")).select("row.doc_id", "n_tokens", "score")


@query("op3_language_id")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    held_out = remainder(F.col("doc_id"), 4) == 2
    prototypes = language.learn(docs.where(~held_out))
    return language.identify(docs, prototypes).select(
        "row.doc_id", (remainder(F.col("row.doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score"
    )


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, o.vec_id, CAST(list_dot_product(CAST(q.c AS DOUBLE[]), CAST(o.c AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v o ON q.vec_id <> o.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
FROM pairs WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""


@query("op4_exact_top_k", TOP_K_SQL)
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return top_k.exact_top_k(table(spark, sf, "embeddings"))


@query("op9_embedding_near_dedup")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return vector_dedup.near_vectors(table(spark, sf, "embeddings")).select(
        F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"),
    )


@query("op8_lm_scores")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return attention_lm.score_documents(docs, remainder(F.col("doc_id"), 5) == 1).withColumnRenamed("id", "doc_id")


# CRC-32 bit by bit. Insert never is part of a cheapest repair: without the inserted row and the other one of its pair
# (at most 2 to delete) the rest still fits and costs less; so the recursion over rows needs Delete, Keep and Rerole only.
REPAIR_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
           string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: ascii(c)::BIGINT)),
           lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0,0,0,0,0,0,0,0]::BIGINT[]), lambda c, z: xor(c >> 1, 3988292384 * (c & 1))))) % 20 AS kind
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM keyed
), ordered AS (
  SELECT *, left(role, 1) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth
  FROM damaged
), marked AS (
  SELECT *, CASE WHEN t = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
         lag(i) OVER (PARTITION BY conv_id ORDER BY pos) || i AS pair
  FROM ordered
), measures AS (
  SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps,
         count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n
  FROM marked GROUP BY conv_id
), paths AS (
  SELECT conv_id, 0::BIGINT AS pos, '' AS state, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS lines FROM measures
  UNION ALL
  SELECT conv_id, pos, state, cost, audit, lines FROM (
    SELECT p.conv_id, m.pos, e.edit, p.audit || e.edit AS audit,
           CASE e.edit WHEN 'D' THEN p.state WHEN 'K' THEN m.i WHEN 'R' THEN CASE WHEN p.state = 'u' THEN 'a' ELSE 'u' END END AS state,
           p.cost + CASE e.edit WHEN 'D' THEN 2 WHEN 'K' THEN 0 ELSE 1 END + CASE WHEN e.edit <> 'D' AND m.fault = 't' THEN 5 ELSE 0 END AS cost,
           CASE e.edit WHEN 'D' THEN p.lines WHEN 'K' THEN list_append(p.lines, m.role || ':' || m.text)
             ELSE list_append(p.lines, CASE WHEN p.state = 'u' THEN 'assistant:' ELSE 'user:' END || m.text) END AS lines
    FROM paths p JOIN marked m ON m.conv_id IS NOT DISTINCT FROM p.conv_id AND m.pos = p.pos + 1
    JOIN (VALUES ('D'), ('K'), ('R')) e(edit) ON e.edit = 'D' OR (m.fault NOT IN ('b', 'd') AND (e.edit = 'R'
      OR (m.i = 's' AND p.state = '') OR (m.i = 'u' AND p.state IN ('', 's', 'a')) OR (m.i = 'a' AND p.state = 'u')))
  ) QUALIFY row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) = 1
), best AS (
  SELECT p.* FROM paths p JOIN measures m ON m.conv_id IS NOT DISTINCT FROM p.conv_id AND m.n = p.pos
  WHERE p.state IN ('', 'a') QUALIFY row_number() OVER (PARTITION BY p.conv_id ORDER BY p.cost, p.audit) = 1
)
SELECT c.conv_id, coalesce(m.gaps, 0) AS gaps, coalesce(m.blank, 0) AS blank, coalesce(m.duplicate, 0) AS duplicate,
       coalesce(m.truncated, 0) AS truncated, coalesce(m.illegal, 0) AS illegal, coalesce(b.cost, 0) AS cost,
       coalesce(b.audit, '') AS audit, sha256(coalesce(array_to_string(b.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN measures m ON m.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
"""


@query("op11_conversation_repair", REPAIR_SQL)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations")
    return conversation_repair.report(rows, conversation_repair.damaged(rows))


@query("op13_token_alignment")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return token_alignment.align(table(spark, sf, "documents"), groups="sha256").select(
        F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256")
    )


# Every given page has one plain article element; the references in them are those of the replacements.
PAGES_SQL = r"""
WITH cut AS (
  SELECT page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|$)', 1, 's'), '</?(p|h1)>') AS parts
  FROM pages
), clean AS (
  SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(replace(regexp_replace(replace(
    regexp_replace(x, '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'), chr(160), ' '), '\s+', ' ', 'g'))) AS blocks
  FROM cut
), joined AS (SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10)) AS text FROM clean)
SELECT page_id, url, text, length(text) AS n_chars FROM joined
"""


@query("op12_html_extraction", PAGES_SQL)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    return wrappers.extract(pages, wrappers.infer(pages)).select("row.page_id", "row.url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
