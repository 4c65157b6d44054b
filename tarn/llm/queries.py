"""The operators as queries over the tables of a folder, and what SQL can say of their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import chat, decontam, ngram_join, packing, pages, pii, quality, substring, topk, toxicity
from tarn.llm._store import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.report(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The tool that op10's derived conversations call.
NOTE_SCHEMA = [("note", "quote", "string", True), ("note", "turn", "integer", True), ("note", "tags", "array", False)]


def with_calls(messages: DataFrame) -> DataFrame:
    """The messages, and each conversation once more with tool calls, under the number -1 - conv_id.

    There an assistant's turn is a call that quotes it, with an argument of the wrong type in every fourth turn, and
    what others said in the turn before is its result, which stands before its call.
    """
    text, turn = F.coalesce("text", F.lit("")), F.col("turn").cast("bigint")
    quote = F.substring(text, 1, 20).alias("quote")
    call = lambda given: F.to_json(F.struct(text.alias("content"), F.array(F.struct(F.concat(F.lit("c"), turn.cast("string")).alias("id"), F.lit("note").alias("name"), given.alias("arguments"))).alias("tool_calls")))
    asked = F.when(turn % 4 == 3, call(F.to_json(F.struct(quote, turn.cast("string").alias("turn"))))).otherwise(call(F.to_json(F.struct(quote, turn.alias("turn")))))
    result = F.to_json(F.struct(F.concat(F.lit("c"), (turn + 1).cast("string")).alias("tool_call_id"), text.alias("content")))
    asks = F.col("role") == "assistant"
    derived = messages.select((-1 - F.col("conv_id")).alias("conv_id"), "turn", F.when(asks, "assistant").otherwise("tool").alias("role"), F.when(asks, asked).otherwise(result).alias("text"))
    return messages.select("conv_id", "turn", "role", "text").unionByName(derived.where("conv_id is not null and turn is not null"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = with_calls(table(spark, sf_dir, "conversations"))
    linked = chat.link(messages, spark.createDataFrame(NOTE_SCHEMA, chat.SCHEMA))
    return linked.withColumn("errors", F.array_join("errors", "; "))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pii, op2_html_text, op3_topk, op4_decontamination, op5_quality, op6_substring_dedup, op7_packing, op8_ngram_join, op9_toxicity, op10_chat)
}

OP3_SQL = r"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.r, q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.e, d.e) AS BIGINT) AS score FROM v q, v d WHERE q.vec_id % 20 = 0 AND d.vec_id <> q.vec_id),
k AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 20
"""

OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
i AS (SELECT row_number() OVER () AS gid, item_id, g, len(g) AS n FROM (SELECT DISTINCT item_id, w[s : s + least(10, len(w)) - 1] AS g FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS s FROM b WHERE len(w) > 0))),
g AS (SELECT item_id, array_to_string(g, ' ') AS gram, n FROM i),
lens AS (SELECT DISTINCT n FROM g),
h AS (SELECT r, x.n, s, array_to_string(w[s : s + x.n - 1], ' ') AS gram
      FROM (SELECT r, w, lens.n, unnest(range(1, len(w) - lens.n + 2)) AS s FROM d, lens WHERE len(w) >= lens.n) x),
m AS (SELECT h.r, h.s, h.n, g.item_id FROM h JOIN g ON h.gram = g.gram AND h.n = g.n),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(s, s + n)) AS p FROM m) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT r, item_id FROM m) GROUP BY r),
-- windows whose words are all within 2 of their places: from places of the rarest word, then of the next, then of all
gt AS (SELECT gid, n, unnest(g) AS term, unnest(range(0, n)) AS k FROM i),
tok AS (SELECT r, term, p FROM (SELECT r, unnest(w) AS term, unnest(range(0, len(w))) AS p FROM d) WHERE term IN (SELECT term FROM gt)),
o AS (SELECT gid, gt.term, k, row_number() OVER (PARTITION BY gid ORDER BY coalesce(f, 0), k) AS o FROM gt LEFT JOIN (SELECT term, count(*) AS f FROM tok GROUP BY term) df ON df.term = gt.term),
c0 AS (SELECT gid, r, p - k - x AS at FROM o JOIN tok USING (term), (SELECT unnest(range(-2, 3)) AS x) WHERE o = 1),
c1 AS (SELECT DISTINCT c0.gid, c0.r, c0.at FROM c0 JOIN o ON o.gid = c0.gid AND o.o = 2 JOIN tok ON tok.r = c0.r AND tok.term = o.term AND tok.p BETWEEN c0.at + o.k - 2 AND c0.at + o.k + 2
       UNION ALL SELECT c0.* FROM c0 JOIN i USING (gid) WHERE n = 1),
c2 AS (SELECT c1.gid, c1.r FROM c1 JOIN gt ON gt.gid = c1.gid JOIN tok ON tok.r = c1.r AND tok.term = gt.term AND tok.p BETWEEN c1.at + gt.k - 2 AND c1.at + gt.k + 2 GROUP BY 1, 2, c1.at HAVING count(DISTINCT gt.k) = max(gt.n)),
nr AS (SELECT r, count(DISTINCT item_id) AS n_near FROM c2 JOIN i USING (gid) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON hit.r = d.r LEFT JOIN it ON it.r = d.r LEFT JOIN nr ON nr.r = d.r
"""

OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
h AS (SELECT r, doc_id, s, array_to_string(w[s : s + 49], ' ') AS gram FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50)),
f AS (SELECT gram, min(doc_id) AS first FROM h GROUP BY gram HAVING count(DISTINCT doc_id) > 1),
gone AS (SELECT r, list(DISTINCT p) AS ps FROM (SELECT h.r, unnest(range(h.s, h.s + 50)) AS p FROM h JOIN f ON h.gram = f.gram AND h.doc_id > f.first) GROUP BY r),
kept AS (SELECT d.r, string_agg(x, ' ' ORDER BY p) AS k, count(*) AS n
         FROM (SELECT d.r, unnest(d.w) AS x, unnest(range(1, len(d.w) + 1)) AS p FROM d) d
         WHERE NOT EXISTS (SELECT 1 FROM (SELECT r, unnest(ps) AS p FROM gone) g WHERE g.r = d.r AND g.p = d.p) GROUP BY d.r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.k, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.r = d.r
"""

OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT r, array_to_string(w[s : s + least(5, len(w)) - 1], ' ') AS gram
      FROM (SELECT r, w, unnest(range(1, greatest(2, len(w) - 3))) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.r <> b.r GROUP BY 1, 2),
l AS (SELECT a, b, c = na.n AND c = nb.n AS same FROM p JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE c >= 0.8 * (na.n + nb.n - c) - 1e-9),
t(x, y) AS (SELECT r, r FROM d UNION SELECT t.x, l.b FROM t JOIN l ON l.a = t.y),
k AS (SELECT x, min(doc_id) AS class_id FROM t JOIN d ON d.r = t.y GROUP BY x),
e AS (SELECT a, count(*) AS n_links, min(CASE WHEN same THEN d.doc_id END) AS copy FROM l JOIN d ON d.r = l.b GROUP BY a)
SELECT d.doc_id, least(d.doc_id, e.copy) AS copy_id, k.class_id, CAST(coalesce(e.n_links, 0) AS BIGINT) AS n_links
FROM d JOIN k ON k.x = d.r LEFT JOIN e ON e.a = d.r
"""

OP10_SQL = r"""
WITH m AS (SELECT row_number() OVER () AS r, conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT conv_id, turn, coalesce(role, 'user') AS role, text FROM m),
q AS (SELECT * FROM m WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
a AS (SELECT r, -1 - conv_id AS conv_id, turn, text, row_number() OVER (PARTITION BY conv_id, turn ORDER BY r) = 1 AS first FROM q WHERE role = 'assistant'),
t AS (SELECT r, -1 - conv_id AS conv_id, turn, text, row_number() OVER (PARTITION BY conv_id, turn ORDER BY r) = 1 AS first FROM q WHERE role IS NULL OR role <> 'assistant')
SELECT conv_id, turn, role, turn AS at_turn, CAST(0 AS INTEGER) AS at_step, CAST(0 AS INTEGER) AS n_calls, CAST(NULL AS VARCHAR) AS call_id,
       'plain' AS status, '' AS errors, '{"content":' || CAST(to_json(text) AS VARCHAR) || ',"role":' || CAST(to_json(role) AS VARCHAR) || '}' AS json
FROM p
UNION ALL
SELECT a.conv_id, a.turn, 'assistant', a.turn, CAST(0 AS INTEGER), CAST(1 AS INTEGER), CAST(NULL AS VARCHAR),
       CASE WHEN a.turn % 4 = 3 THEN 'invalid' WHEN a.first AND t.r IS NOT NULL THEN 'calls' ELSE 'unanswered' END, CASE WHEN a.turn % 4 = 3 THEN 'turn is no integer' ELSE '' END,
       '{"content":' || CAST(to_json(a.text) AS VARCHAR) || ',"role":"assistant","tool_calls":[{"arguments":{"quote":' || CAST(to_json(substring(a.text, 1, 20)) AS VARCHAR) || ',"turn":'
       || CASE WHEN a.turn % 4 = 3 THEN '"' || a.turn || '"' ELSE CAST(a.turn AS VARCHAR) END || '},"id":"c' || a.turn || '","name":"note"}]}'
FROM a LEFT JOIN t ON t.conv_id = a.conv_id AND t.turn = a.turn - 1 AND t.first
UNION ALL
SELECT t.conv_id, t.turn, 'tool', coalesce(a.turn, t.turn), CAST(CASE WHEN a.r IS NULL THEN 0 ELSE 1 END AS INTEGER), CAST(0 AS INTEGER), 'c' || (t.turn + 1),
       CASE WHEN a.r IS NULL THEN 'orphan' WHEN t.first THEN 'linked' ELSE 'duplicate' END, '',
       '{"content":' || CAST(to_json(t.text) AS VARCHAR) || ',"role":"tool","tool_call_id":"c' || (t.turn + 1) || '"}'
FROM t LEFT JOIN a ON a.conv_id = t.conv_id AND a.turn = t.turn + 1 AND a.first
"""

ORACLE_SQL: dict[str, str] = {"op3_topk": OP3_SQL, "op4_decontamination": OP4_SQL, "op6_substring_dedup": OP6_SQL, "op8_ngram_join": OP8_SQL, "op10_chat": OP10_SQL}
