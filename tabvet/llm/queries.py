"""The registered queries of this subpackage: one ``opN_<name>`` for each operator, each
over its whole table, and the DuckDB restatements where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabvet.llm.common import documents, shared_folder


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabvet.llm.decontaminate import leaks
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabvet.llm.bpe import round_trip
    return round_trip(documents(spark, sf_dir))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabvet.llm.lm import score
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))
    out = score(documents(spark, sf_dir), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def _flip(page_id: int | None, raw: bytes) -> bytes:
    """The faulty replica of the fixity query: one byte of some records is changed."""
    if page_id is None or page_id * 2654435761 % 1009 >= 5:
        return raw
    k = page_id % len(raw)
    return raw[:k] + bytes([raw[k] ^ 1]) + raw[k + 1:]


def op4_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabvet.llm.warc import fixity, write_warc
    out = f"{shared_folder(spark)}/warc"
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), out)
    return fixity(spark, out, _flip).select("page_id", F.col("length").alias("n_bytes"), F.col("sha").alias("record_sha256"), "damaged")


OP4_SQL = """
WITH r AS (
  SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
    || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A') || chr(13) || chr(10)
    || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10)
    || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') AS rec
  FROM pages)
SELECT page_id, CAST(strlen(rec) AS BIGINT) AS n_bytes, sha256(rec) AS record_sha256,
       coalesce(page_id * 2654435761 % 1009 < 5, false) AS damaged
FROM r"""


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabvet.llm.language import fit, predict
    docs = documents(spark, sf_dir)
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    return predict(docs, fit(docs, where=~held_out)).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabvet.llm.orc_tokens import token_index, write_tokens
    out = f"{shared_folder(spark)}/tokens"
    write_tokens(documents(spark, sf_dir), out)
    return token_index(spark, out)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabvet.llm.jaccard import jaccard_components
    return jaccard_components(documents(spark, sf_dir))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabvet.llm.lines import dedup_lines
    return dedup_lines(documents(spark, sf_dir), report=True).select("doc_id", F.size("removed").cast("long").alias("n_removed"), "removed", "text")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabvet.llm.licenses import scan
    return scan(documents(spark, sf_dir))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabvet.llm.quality import judge
    return judge(documents(spark, sf_dir))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabvet.llm.negatives import mine
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", noisy), F.col("vec_id") % 50 == 0)


OP11_SQL = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.id AS anchor_id, r.id AS id, a.label = r.label AS same, CAST(list_dot_product(a.q, r.q) AS BIGINT) AS score
  FROM v a JOIN v r ON a.id <> r.id WHERE a.id % 50 = 0),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabvet.llm.collocations import collocations
    return collocations(documents(spark, sf_dir))


OP12_SQL = """
WITH piece AS (
  SELECT row_number() OVER () AS id, lang, piece FROM (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents WHERE text IS NOT NULL)),
word AS (
  SELECT id, lang, unnest(w) AS w, unnest(range(len(w))) AS k FROM (
    SELECT id, lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM piece)),
gram AS (
  SELECT lang, w AS w1, lead(w, 1) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM word WINDOW p AS (PARTITION BY id ORDER BY k)),
f AS (
  SELECT lang, w1 AS phrase, 1 AS size, count(*) AS a, any_value(w1) AS w1, '' AS w2, '' AS w3 FROM gram GROUP BY lang, w1
  UNION ALL
  SELECT lang, w1 || ' ' || w2, 2, count(*), w1, w2, '' FROM gram WHERE w2 IS NOT NULL GROUP BY lang, w1, w2 HAVING count(*) >= 10
  UNION ALL
  SELECT lang, w1 || ' ' || w2 || ' ' || w3, 3, count(*), w1, w2, w3 FROM gram WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3 HAVING count(*) >= 10),
key AS (SELECT lang || chr(1) || phrase AS key, a FROM f),
parts AS (
  SELECT lang, phrase, size, a, 1 AS k, w1 AS first, CASE size WHEN 2 THEN w2 ELSE w2 || ' ' || w3 END AS rest FROM f WHERE size > 1
  UNION ALL
  SELECT lang, phrase, size, a, 2, w1 || ' ' || w2, w3 FROM f WHERE size = 3),
cuts AS (
  SELECT c.lang, c.phrase, c.size, c.a, k, x.a AS l, y.a AS r,
         CAST((CAST(c.a AS HUGEINT) * c.a * 1000000) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM parts c JOIN key x ON x.key = c.lang || chr(1) || first JOIN key y ON y.key = c.lang || chr(1) || rest),
best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, w1 || ' ' || w2 AS phrase, a FROM f WHERE size = 3 UNION ALL SELECT lang, w2 || ' ' || w3, a FROM f WHERE size = 3)
  GROUP BY lang, phrase),
total AS (SELECT lang, sum(a) AS n FROM f WHERE size = 1 GROUP BY lang)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, encode(b.phrase)) AS rank,
       b.phrase, b.a, l, r, CAST(n AS BIGINT) AS n, score
FROM best b JOIN total ON total.lang = b.lang LEFT JOIN longer x ON x.lang = b.lang AND x.phrase = b.phrase
WHERE coalesce(100 * x.a < 50 * b.a, true)
QUALIFY rank <= 2000"""


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabvet.llm.toxicity import score
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    out = score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_bpe": op2_bpe,
    "op3_lm_score": op3_lm_score,
    "op4_warc_fixity": op4_warc_fixity,
    "op5_language_id": op5_language_id,
    "op6_orc_tokens": op6_orc_tokens,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_line_dedup": op8_line_dedup,
    "op9_license_scan": op9_license_scan,
    "op10_quality": op10_quality,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_collocations": op12_collocations,
    "op13_toxicity": op13_toxicity,
}


def oracle_sql() -> dict[str, str]:
    return {"op4_warc_fixity": OP4_SQL, "op11_hard_negatives": OP11_SQL, "op12_collocations": OP12_SQL}
