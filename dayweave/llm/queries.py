"""The registered queries of this folder: every operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import PATTERN, path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayweave.llm import bpe, hard_negatives, language, main_text, near_vectors, packing, quality, simhash, spelling, syncmers, toxicity, unigram, warc
from dayweave.llm.common import remainder, stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


@query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("bits")).alias("fingerprint"), "component_id")


@query
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    rest = remainder(F.col("doc_id"), 4)
    model = language.learn(docs.where(rest != 2))
    found = docs.select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), language.predicted(F.col("text"), model, spark).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"), F.col("found.bits").alias("code_bits"))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; learned from the labelled documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    rest = remainder(F.col("doc_id"), 5)
    model = toxicity.learn(docs.where(rest != 0), table(spark, sf_dir, "labels"))
    found = docs.select("doc_id", F.coalesce(rest == 0, F.lit(False)).alias("held_out"), toxicity.scored(F.col("text"), model, spark).alias("found"))
    return found.select("doc_id", "held_out", "found.score", "found.predicted", F.col("found.language").alias("text_language"), "found.chance", "found.threshold")


@query
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document to ids and back to bytes."""
    ranks = path("byte_bpe_50k.tiktoken")
    ids = table(spark, sf_dir, "documents").select("doc_id", bpe.encoded(F.col("text"), ranks, PATTERN).alias("ids"))
    both = ids.withColumn("bytes", bpe.decoded(F.col("ids"), ranks, PATTERN))
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), PATTERN)


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token count of every document, and the score of its best segmentation."""
    found = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n_chars"), unigram.token_counts(F.col("text"), path("piece_bpe_32k.model")).alias("found"))
    return found.select("doc_id", "n_chars", "found.n_tokens", "found.score")


@query
def op3_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they and the next document's are."""
    rows = syncmers.edited(table(spark, sf_dir, "documents"))
    for text, out in (("text", "own"), ("edited", "other"), ("next_text", "next")):
        rows = syncmers.with_fingerprint(rows, text, out)
    for other, out in (("other", "near_edited"), ("next", "near_next")):
        rows = syncmers.with_likeness(rows, "own", other, out)
    return rows.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        syncmers.written(F.col("own")).alias("fingerprint"),
        syncmers.written(F.col("other")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


@query
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to Zstandard WARC archives and read back."""
    return warc.archive(table(spark, sf_dir, "pages")).drop("url")


@query
def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = table(spark, sf_dir, "pages").select("page_id", "url", main_text.extracted(F.col("html")).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query
def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and group of every embedding."""
    return near_vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 50th embedding; every seventh has a label moved by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, label=label)


@query
def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; learned from the labelled documents that are not held out."""
    rows = stored(table(spark, sf_dir, "documents").select("doc_id", quality.read(F.col("text")).alias("statistics")), "statistics")
    rest = remainder(F.col("doc_id"), 4)
    model = quality.learn(rows.where(rest != 2), table(spark, sf_dir, "labels"))
    found = rows.select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), quality.scored(F.col("statistics"), model, spark).alias("found"))
    return found.select("doc_id", "held_out", "found.score", "found.predicted")


@query
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of the words of all documents, some of them damaged."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), damaged=199)


ORACLES["op1_near_vectors"] = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen),
lows AS (SELECT node, min(seen) AS low FROM reach GROUP BY node),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, low AS component_id, e.vec_id = low AS kept
FROM embeddings e LEFT JOIN lows ON node = e.vec_id LEFT JOIN counts ON a = e.vec_id
"""

ORACLES["op4_warc"] = """
WITH sized AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages WHERE page_id IS NOT NULL),
bits AS (
  SELECT page_id, strlen(payload) AS size, hex, min(page_id) OVER (PARTITION BY payload) AS low,
    array_to_string(list_transform(range(40), lambda i: lpad(bin(strpos('0123456789abcdef', substr(hex, i + 1, 1)) - 1), 4, '0')), '') AS digits FROM sized)
SELECT page_id, size AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST(list_sum(list_transform(range(5), lambda j: CAST(substr(digits, 5 * i + j + 1, 1) AS INTEGER) * CAST(2 ** (4 - j) AS INTEGER))) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN low = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN low <> page_id THEN low END AS refers_to, CAST(NULL AS VARCHAR) AS problem
FROM bits
"""

ORACLES["op11_hard_negatives"] = """
WITH used AS (
  SELECT vec_id AS id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM used a JOIN used b ON a.id % 50 = 0 AND b.id <> a.id AND len(a.v) = len(b.v)),
positive AS (
  SELECT anchor_id, id, score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
  n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positive p JOIN scored n USING (anchor_id)
WHERE NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY anchor_id, p.id ORDER BY n.score DESC, n.id) <= 3
"""

ORACLES["op13_spelling"] = """
WITH RECURSIVE bits AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, CAST(b AS BIGINT))) AS steps),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{C0}-\\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS times, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS digits FROM runs GROUP BY ALL),
hashed AS (
  SELECT run, times, length(run) AS size, xor(4294967295, list_reduce(
    list_transform(range(length(digits) // 2), lambda i: CAST((strpos('0123456789ABCDEF', digits[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', digits[2 * i + 2]) - 1 AS BIGINT)),
    lambda c, b: xor(c // 256, steps[xor(c % 256, b) + 1]), CAST(4294967295 AS BIGINT))) AS h FROM counted, bits),
spelled AS (SELECT CASE WHEN h % 199 = 0 THEN run[1 : h % size] || run[h % size + 2 :] ELSE run END AS word, times FROM hashed),
words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM spelled WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
holes AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS spot FROM words),
cut AS (SELECT word, n, spot, word[1 : spot - 1] || word[spot + 1 :] AS rest FROM holes),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.spot = b.spot AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near FROM near
  QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, encode(other)) = 1),
forms AS (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n
  FROM words LEFT JOIN best ON words.word = best.word),
chain AS (SELECT word, word AS root FROM forms UNION SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
FROM forms f JOIN chain c ON f.word = c.word JOIN forms l ON l.word = c.root AND l.form IS NULL
"""
