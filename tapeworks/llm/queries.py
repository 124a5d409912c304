"""The corpus operators' queries over whole tables, and their SQL where SQL has them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .align import aligned_documents
from .bpe import encode, read_ranks
from .common import table
from .hnsw import nearest
from .html_text import extract_pages
from .lm import lm_scores
from .media import read_media, to_media
from .merkle import document_manifest
from .mixing import mix
from .ngram_join import jaccard_join
from .passages import repeated_passages
from .quality import quality_scores
from .rollups import corpus_rollup
from .vector_dups import near_duplicates


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score and label of each document, by preference pairs of labelled ones."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the size of its set of shingles, its class of equal sets and its component of linked ones."""
    return jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its source's target, how often it is taken and its first training position; in that order."""
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", F.round("position", 9).alias("position")).orderBy("position", "doc_id")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of each page."""
    return extract_pages(table(spark, sf_dir, "pages"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(doc_id::VARCHAR) AS k FROM documents),
s AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)),
w AS (SELECT *, CASE rk % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, source_size * 3 AS cap FROM s),
f AS (
  SELECT *, row_number() OVER o AS fill,
    sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS heavy
  FROM w WINDOW o AS (ORDER BY source_size::DOUBLE / w, rk)),
g AS (SELECT *, rest::DOUBLE / heavy::DOUBLE AS lv FROM f),
h AS (SELECT *, CASE WHEN lv * w <= cap THEN fill END AS free FROM g),
t AS (
  SELECT source, rk, source_size,
    CASE WHEN fill < min(free) OVER () THEN cap::DOUBLE ELSE (arg_min(lv, free) OVER ()) * w END AS target FROM h),
c AS (
  SELECT d.doc_id, d.size, t.rk, t.source_size, t.target,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS start,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS passes
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
n AS (
  SELECT *, least(passes + (start + size / 2.0 <= target - passes * source_size)::INT, 3)::INT AS copies,
    coalesce(least(1.0, CASE WHEN target > 0 THEN start / target END), 0.0) AS u FROM c)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies,
  round(CASE WHEN copies = 0 THEN NULL
    WHEN rk % 3 = 0 AND u < 0.625 THEN (sqrt(2.25 - 2.0 * u) - 1.5) / -1.0
    WHEN rk % 3 = 0 THEN 0.5 + (sqrt(greatest(0.0, 1.0 - 2.0 * (u - 0.625))) - 1.0) / -1.0
    WHEN rk % 3 = 1 THEN u
    WHEN u < 0.46875 / 0.875 THEN (sqrt(0.25 * 0.25 / 0.765625 + 2.0 / 0.875 * u) - 0.25 / 0.875) / (1.0 / 0.875)
    ELSE 0.75 + (sqrt(1.0 / 0.765625 + 10.0 / 0.875 * (u - 0.46875 / 0.875)) - 1.0 / 0.875) / (5.0 / 0.875) END, 9) + 0.0 AS position
FROM n
"""


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of each document that align with one of a document before it."""
    return repeated_passages(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document the number of tokens, and digests of its ids and of what they decode to."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, digests=True)
    return coded.select("doc_id", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of each document by word counts and by the attention model."""
    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return lm_scores(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op8_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest other vectors of every hundredth one."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text as an AVI file: sizes and digests of the payload read back and of the file, and its clips."""
    read = read_media(to_media(table(spark, sf_dir, "documents")))
    clip = lambda c: F.concat_ws("-", c["first_frame"], c["last_frame"], c["start_ms"], c["end_ms"])
    return read.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.array_join(F.transform("clips", clip), ";").alias("feature"))


def op10_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and tokens of distinct texts by source, language and tokenizer version."""
    return corpus_rollup(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH d AS (
  SELECT source, lang, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS a,
    coalesce(len(regexp_extract_all(text, '[A-Za-z]+|[0-9]{1,3}|[^A-Za-z0-9\x20\x09-\x0D]')), 0) AS b,
    text IS NULL OR doc_id = min(doc_id) OVER (PARTITION BY text) AS kept
  FROM documents)
SELECT source, lang, 'words-1' AS tokenizer, sum(kept::INT)::BIGINT AS n_docs, coalesce(sum(a) FILTER (kept), 0)::BIGINT AS n_tokens FROM d GROUP BY ALL
UNION ALL
SELECT source, lang, 'pieces-1', sum(kept::INT)::BIGINT, coalesce(sum(b) FILTER (kept), 0)::BIGINT FROM d GROUP BY ALL
"""


def op11_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector with the number of its near duplicates of the same label and their component."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP11_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
f AS (
  SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS long FROM v
  WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM f a JOIN f b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.long * b.long) >= 0.98),
r AS (SELECT vec_id, vec_id AS low FROM v UNION SELECT l.a, r.low FROM r JOIN l ON l.b = r.vec_id WHERE r.low < l.a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM (SELECT vec_id, min(low) AS component_id FROM r GROUP BY vec_id) LEFT JOIN n USING (vec_id)
"""


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two tokenizers align in each document, and how common its links are in the corpus."""
    files = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return aligned_documents(table(spark, sf_dir, "documents"), *files, public_tokenizers.PATTERN)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's leaf and proof in the tree of all documents, held against a leaf that may have been tampered with."""
    return document_manifest(table(spark, sf_dir, "documents"))


def _merkle_sql(depth: int = 12) -> str:
    """A tree of up to 8^depth leaves a language, and as many languages."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    rest = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bit = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    byte = "list_reduce(list_concat([xor(c & 255, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: " + bit + ")"
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda c, b: xor(c >> 8, {byte})), 4294967295)"

    def climb(name: str) -> str:
        steps = []
        for k in range(depth):
            steps.append(f"{name}r{k} AS (SELECT g, pos // 8 AS p, list(digest ORDER BY pos) AS run FROM {name}{k} WHERE n > 1 GROUP BY ALL)")
            steps.append(f"{name}{k + 1} AS (SELECT g, pos // 8 AS pos, any_value((n + 7) // 8) AS n, sha256(string_agg(digest, '' ORDER BY pos)) AS digest FROM {name}{k} WHERE n > 1 GROUP BY ALL)")
        return ",\n".join(steps)

    def fold(name: str, runs: str) -> str:
        steps = []
        for k in range(depth):
            before, after = f"array_to_string(r.run[1:c.pos % 8], '')", "array_to_string(r.run[c.pos % 8 + 2:8], '')"
            steps.append(
                f"{name}{k + 1} AS (SELECT c.* EXCLUDE (pos, acc, proof), c.pos // 8 AS pos, CASE WHEN r.run IS NULL THEN acc ELSE sha256({before} || acc || {after}) END AS acc, "
                f"proof || CASE WHEN r.run IS NULL THEN '' ELSE {before} || {after} END AS proof FROM {name}{k} c LEFT JOIN {runs}r{k} r ON c.g = r.g AND c.pos // 8 = r.p)"
            )
        return ",\n".join(steps)

    tops = lambda name: " UNION ALL ".join(f"SELECT g, digest FROM {name}{k} WHERE n = 1" for k in range(depth + 1))
    return f"""
WITH h AS (
  SELECT doc_id, coalesce('1' || lang, '0') AS g, sha256({rest} || {field("text")}) AS leaf,
    CASE WHEN {crc} % 3 = 0 THEN sha256({rest} || {field(lowered)}) END AS tampered FROM documents),
d AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM h),
a0 AS (SELECT g, pos, n, leaf AS digest FROM d),
{climb("a")},
s AS ({tops("a")}),
b0 AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n, digest FROM s),
{climb("b")},
t AS ({tops("b")}),
c0 AS (SELECT doc_id, leaf, g, pos, coalesce(tampered, leaf) AS acc, '' AS proof FROM d),
{fold("c", "a")},
p AS (SELECT g, digest AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos FROM s),
e0 AS (SELECT c.doc_id, c.leaf, p.subroot, '' AS g, p.pos, c.acc, c.proof FROM c{depth} c JOIN p ON c.g = p.g),
{fold("e", "b")}
SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = digest AS verified FROM e{depth} e, t
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": OP3_SQL, "op10_token_rollup": OP10_SQL, "op11_embedding_dups": OP11_SQL, "op13_merkle": _merkle_sql()}
