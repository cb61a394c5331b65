"""The queries of the corpus operators: thin functions of (spark, sf_dir), and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chainloom.llm.alignment import align
from chainloom.llm.common import table
from chainloom.llm.exact_dedup import exact_dedup
from chainloom.llm.fingerprints import compare_edited
from chainloom.llm.html_text import extract_text
from chainloom.llm.licenses import license_scan
from chainloom.llm.line_dedup import line_dedup
from chainloom.llm.mixing import mix
from chainloom.llm.near_dedup import near_dedup
from chainloom.llm.negatives import mine, whole_vectors
from chainloom.llm.packing import pack
from chainloom.llm.personal import scan_personal
from chainloom.llm.token_counts import count_tokens, sample_edits
from chainloom.llm.toxicity import fit_toxicity, score_toxicity


def tokenizer(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("detections")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_removed", "text")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "position")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP4_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""

def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).drop("evidence")


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), sample_edits())


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_personal(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(whole_vectors(table(spark, sf_dir, "embeddings")))


OP13_SQL = """
WITH r AS (
  SELECT vec_id AS id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
s AS (
  SELECT a.id AS anchor_id, x.id, a.label = x.label AS same, CAST(list_inner_product(a.v, x.v) AS BIGINT) AS score
  FROM r a JOIN r x ON a.id <> x.id WHERE a.id % 100 = 0),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score
  FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER w <= 5
"""

OP3_SQL = """
WITH d AS (
  SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
w AS (
  SELECT doc_id, p, l[p + 1] AS a, l[p + 2] AS b, l[p + 3] AS c
  FROM (SELECT doc_id, l, unnest(range(0, len(l) - 2)) AS p FROM d WHERE len(l) >= 3)
  WHERE trim(l[p + 1]) <> '' OR trim(l[p + 2]) <> '' OR trim(l[p + 3]) <> ''),
f AS (
  SELECT *, first_value(doc_id) OVER o AS fd, first_value(p) OVER o AS fp
  FROM w WINDOW o AS (PARTITION BY a, b, c ORDER BY doc_id, p)),
r AS (
  SELECT DISTINCT doc_id, unnest(range(CASE WHEN fd = doc_id THEN greatest(p, fp + 3) ELSE p END, p + 3)) AS q
  FROM f WHERE NOT (fd = doc_id AND fp = p)),
k AS (
  SELECT d.doc_id, list(q) AS gone FROM d JOIN r ON d.doc_id = r.doc_id GROUP BY d.doc_id)
SELECT d.doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(l) END AS n_lines, coalesce(len(gone), 0) AS n_removed,
       CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string(
         [l[i + 1] FOR i IN range(0, len(l)) IF NOT list_contains(gone, i)], chr(10)), '') END AS text
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_license_scan": op2_license_scan,
    "op3_line_dedup": op3_line_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op8_fingerprints": op8_fingerprints,
    "op5_html_extract": op5_html_extract,
    "op9_token_counts": op9_token_counts,
    "op6_toxicity": op6_toxicity,
    "op7_mixing": op7_mixing,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_personal_data": op12_personal_data,
    "op13_hard_negatives": op13_hard_negatives,
}

SQL: dict[str, str] = {
    "op3_line_dedup": OP3_SQL,
    "op4_exact_dedup": OP4_SQL,
    "op13_hard_negatives": OP13_SQL,
}
