"""The registered query of each operator, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _util, bpe, dart_minhash, line_dedup, lm_score, media_avi, packing, quality_fm, quality_rules, sharding, toxicity


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.judge(_util.table(spark, sf_dir, "documents"), ["doc_id"])
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rejected")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup(_util.table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.col("_n_exact").alias("n_exact"), F.col("_n_near").alias("n_near"), F.length("_kept_text").cast("long").alias("kept_chars"), F.md5(F.col("_kept_text").cast("binary")).alias("kept_md5"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_util.table(spark, sf_dir, "documents"))


def op4_media_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_avi.digests(_util.table(spark, sf_dir, "documents"), ["doc_id"])


def op5_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _util.table(spark, sf_dir, "documents")
    machine = quality_fm.fit(docs, _util.table(spark, sf_dir, "labels"), modulus=4, held_out=2)
    held_out = (_util.id_remainder("doc_id", 4) == 2).alias("held_out")
    return quality_fm.score(docs, machine, ["doc_id"]).select("doc_id", held_out, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.assign(_util.table(spark, sf_dir, "documents"), 16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _util.table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _util.table(spark, sf_dir, "labels"), modulus=5, held_out=0)
    held_out = (_util.id_remainder("doc_id", 5) == 0).alias("held_out")
    return toxicity.flag(toxicity.score(docs, model, ["doc_id"])).select("doc_id", held_out, "score", "predicted")


def op8_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.classes(_util.table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(_util.table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, ["doc_id"])


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(_util.table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality_rules, op2_line_dedup, op3_lm_score, op4_media_avi, op5_quality_fm, op6_sharding, op7_toxicity, op8_dart_minhash, op9_bpe, op10_packing)}


OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), pos AS (
  SELECT doc_id, unnest(ws) AS w0, generate_subscripts(ws, 1) AS i FROM w
), tri AS (
  SELECT doc_id, i, w0, lead(w0, 1) OVER o AS w1, lead(w0, 2) OVER o AS w2 FROM pos WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w0, w1, w2) AS c FROM tri WHERE w2 IS NOT NULL) WHERE c > 1
), cov AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, i + unnest([0, 1, 2]) AS j FROM rep) GROUP BY doc_id
), ln AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w
), dup AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
  SELECT w.doc_id, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id)
), v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
), f AS (
  SELECT *, base_failed OR 100 * n_symbols > 25 * n_words OR 100 * n_dup_lines > 30 * n_lines AS failed FROM v
), h AS (
  SELECT source, count(*)::DOUBLE AS n, sum(failed::INT)::DOUBLE AS f FROM f GROUP BY source
), g AS (
  SELECT sum(n) AS nn, sum(f) AS ff, count(*)::DOUBLE AS k, sum(f * f / n) AS fr, sum(n * n) AS n2, sum(f) / sum(n) AS mean FROM h
), b AS (
  SELECT *, mean * (1 - mean) AS w, ((fr - mean * ff) - (k - 1) * mean * (1 - mean)) / nullif(nn - n2 / nn, 0) AS between_ FROM g
), s AS (
  SELECT mean, CASE WHEN between_ > 0 AND w > 0 THEN greatest(w / between_ - 1, 1.0) ELSE 1e9 END AS strength FROM b
), r AS (
  SELECT source, (f + mean * strength) / (n + strength) > 0.6 AS host_rejected FROM h, s
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT failed AND NOT host_rejected AS kept, host_rejected
FROM f JOIN r ON f.source IS NOT DISTINCT FROM r.source
"""

OP2_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents WHERE text IS NOT NULL
), t AS (
  SELECT *, doc_id * 1000000 + no AS ord, trim(regexp_replace(lower(raw), '[ \t\r\f\x0B]+', ' ', 'g')) AS line FROM l
), c AS (
  SELECT *, string_split(line, ' ') AS ws FROM t WHERE line <> ''
), firsts AS (
  SELECT line, min(ord) AS ord, any_value(ws) AS ws FROM c GROUP BY line
), v AS (
  SELECT ord, len(ws) AS n, i, array_to_string(list_concat(ws[1:i - 1], ws[i + 1:len(ws)]), ' ') AS var
  FROM (SELECT ord, ws, unnest(generate_series(1, len(ws))) AS i FROM firsts WHERE len(ws) >= 5)
), sub AS (
  SELECT v.ord FROM v JOIN (SELECT var, i, n, min(ord) AS first FROM v GROUP BY var, i, n HAVING count(*) > 1) g USING (var, i, n) WHERE v.ord > g.first
), ins AS (
  SELECT greatest(v.ord, f.ord) AS ord FROM v JOIN firsts f ON v.var = f.line
), near AS (
  SELECT line FROM firsts WHERE ord IN (SELECT ord FROM sub UNION SELECT ord FROM ins)
), d AS (
  SELECT c.doc_id, c.no, c.ord <> f.ord AS exact, c.line IN (SELECT line FROM near) AS near FROM c JOIN firsts f USING (line)
), k AS (
  SELECT l.doc_id, string_agg(l.raw, chr(10) ORDER BY l.no) FILTER (WHERE NOT coalesce(exact OR near, false)) AS kept,
         coalesce(sum(exact::INT), 0) AS n_exact, coalesce(sum((NOT exact AND near)::INT), 0) AS n_near
  FROM l LEFT JOIN d ON l.doc_id = d.doc_id AND l.no = d.no GROUP BY l.doc_id
)
SELECT doc_id, coalesce(n_exact, 0)::BIGINT AS n_exact, coalesce(n_near, 0)::BIGINT AS n_near,
       CASE WHEN text IS NOT NULL THEN length(coalesce(kept, '')) END::BIGINT AS kept_chars, CASE WHEN text IS NOT NULL THEN md5(coalesce(kept, '')) END AS kept_md5
FROM documents LEFT JOIN k USING (doc_id)
"""

# The checksum is taken byte by byte; its table is made from the polynomial.
OP6_SQL = r"""
WITH k AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) r(i)
), b AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 1 AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes
  FROM documents
), c AS (
  SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295)::BIGINT AS text_crc32 FROM b, k
), s AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto, sum(size) OVER ()::BIGINT AS total FROM c
), t AS (
  SELECT *, least(15, (2 * upto - size) * 16 // (2 * total))::INT AS shard FROM s
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, NULL::INT AS grown_shard FROM t
"""

# All pairs that share a shingle, with no banding: what the signatures must find.
OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\s]+') AS ws FROM documents WHERE doc_id IS NOT NULL
), g AS (
  SELECT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 3, 2)), lambda i: array_to_string(ws[i:i + 4], ' '))) AS sh FROM w WHERE len(ws) > 0
), c AS (
  SELECT doc_id, sh, count(*) AS n FROM g GROUP BY doc_id, sh
), z AS (
  SELECT doc_id, sum(n) AS n FROM c GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.n, y.n)) AS both_ FROM c x JOIN c y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE both_ >= 0.8 * (x.n + y.n - both_)
), u AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r(doc_id, other) AS (
  SELECT DISTINCT doc_id, doc_id FROM w UNION SELECT r.doc_id, u.b FROM r JOIN u ON r.other = u.a
), k AS (
  SELECT doc_id, min(other) AS class_id FROM r GROUP BY doc_id
)
SELECT doc_id, class_id, doc_id = class_id AS is_representative, count(*) OVER (PARTITION BY class_id) AS class_size FROM k
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": OP1_SQL, "op2_line_dedup": OP2_SQL, "op6_sharding": OP6_SQL, "op8_dart_minhash": OP8_SQL}
