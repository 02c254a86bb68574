"""Queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelane.llm.alignment import align_tokenisers
from kinelane.llm.common import read
from kinelane.llm.html_text import extract
from kinelane.llm.minhash import near_duplicate_sets
from kinelane.llm.neighbours import nearest
from kinelane.llm.packing import best_fit
from kinelane.llm.passages import remove_earlier_passages
from kinelane.llm.piece_codec import digests, encode_pieces
from kinelane.llm.quality import COUNTS, quality_rules
from kinelane.llm.repeats import remove_repeats
from kinelane.llm.simhash import near_duplicates
from kinelane.llm.token_counts import count_tokens
from kinelane.llm.toxicity import toxicity
from kinelane.llm.whitening import whiten


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(read(spark, folder, "documents"), shingle=3, distance=3)


def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(read(spark, folder, "documents"), vocabulary("piece_bpe_32k.model"))


def op3_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract(read(spark, folder, "pages"))


def op4_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return best_fit(read(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"))


def op5_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(read(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    found = toxicity(read(spark, folder, "documents"), read(spark, folder, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = quality_rules(read(spark, folder, "documents"), read(spark, folder, "labels"))
    return found.select("doc_id", *COUNTS, "base_failed", "kept", "score")


def op8_piece_codec(spark: SparkSession, folder: str) -> DataFrame:
    return encode_pieces(
        read(spark, folder, "documents"),
        vocabulary("piece_bpe_32k.model"),
        derive=digests,
        columns="n_tokens long, ids_sha256 string, decoded_sha256 string",
    )


def op9_suffix_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(read(spark, folder, "documents"), width=400)


def op10_passages(spark: SparkSession, folder: str) -> DataFrame:
    return remove_earlier_passages(read(spark, folder, "documents"), width=50)


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    found = whiten(read(spark, folder, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return align_tokenisers(read(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op13_superminhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicate_sets(read(spark, folder, "documents"), shingle=2, percent=80)


_ALL = [
    op1_simhash, op2_token_counts, op3_html_text, op4_best_fit_packing, op5_nearest_neighbours, op6_toxicity, op7_quality_rules,
    op8_piece_codec, op9_suffix_repeats, op10_passages, op11_whitening, op12_alignment, op13_superminhash,
]
QUERIES = {f.__name__: f for f in _ALL}
#: DuckDB twins of the operators that SQL can express; the others are tested against libraries and brute force.
PASSAGES_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 50], ' ')) AS k
        FROM (SELECT doc_id, w, unnest(range(len(w) - 49)) AS i FROM d WHERE len(w) >= 50)),
least AS (SELECT k, min(doc_id) AS first FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM (
         SELECT win.doc_id, i, unnest(range(50)) AS j FROM win JOIN least USING (k) WHERE first < win.doc_id)),
words AS (SELECT doc_id, unnest(range(len(w))) AS p, unnest(w) AS word FROM d),
kept AS (SELECT words.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY words.p) AS t
         FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p WHERE gone.p IS NULL GROUP BY words.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""
REPEATS_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT *, CAST(length(h) // 2 AS BIGINT) AS n FROM d),
win AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS k FROM (SELECT doc_id, h, unnest(range(n - 399)) AS i FROM s WHERE n >= 400)),
twice AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
starts AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM win JOIN twice USING (k)),
runs AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM starts),
spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 400 AS b FROM runs GROUP BY doc_id, run),
gaps AS (SELECT doc_id, run, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS since FROM spans),
kept AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS n_spans, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS t, max(b) AS last
         FROM gaps JOIN s USING (doc_id) GROUP BY doc_id)
SELECT s.doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(t, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM s LEFT JOIN kept USING (doc_id)"""

NEAR_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
d AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) END AS s FROM w),
sh AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM d),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.x = b.x AND a.doc_id < b.doc_id AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.r = links.a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, min(r) AS component_id, doc_id = min(r) AS kept FROM d JOIN reach USING (doc_id) GROUP BY doc_id, s"""

SQL = {"op9_suffix_repeats": REPEATS_SQL, "op10_passages": PASSAGES_SQL, "op13_superminhash": NEAR_SQL}
