"""The registered queries of the training-data operators.

``QUERIES`` maps a name to a function of (spark, sf_dir); ``ORACLES`` maps a
name to DuckDB SQL where SQL can express the result on whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, licenses, line_dedup, minhash_dedup, mixing, ngram_join, packing, quality, suffix_dedup, token_alignment, token_counts, toxicity, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all documents: best containment and place of each."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, similarity 0.9: doc_id, n_shingles, component_id."""
    return ngram_join.similarity_components(_table(spark, sf_dir, "documents"), k=3, num=9, den=10)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go: counts and the digest of what stays."""
    out = line_dedup.drop_frequent_lines(_table(spark, sf_dir, "documents"), least=10)
    return out.select("doc.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity by the subword-bag model, and its fold."""
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, base rules and the verdict by distribution divergence."""
    out = quality.quality_rules(_table(spark, sf_dir, "documents"))
    return out.select("doc.doc_id", *quality.BASE, "base_failed", "kept", *(F.round(c, 9).alias(c) for c in ("class_distance", "word_distance")))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(packing.pieces(_table(spark, sf_dir, "documents")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and tokens by source, language and tokenizer version, kept by deltas."""
    return token_counts.maintained(_table(spark, sf_dir, "documents"))


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invertible sketches of every text and its edited text, and their likeness."""
    return fingerprints.fingerprints(_table(spark, sf_dir, "documents"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's calibrated probability and draw."""
    out = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return out.select("doc.doc_id", "doc.source", "doc.lang", "topic", "n_tokens", "probability", "kept")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes in 50-byte strings of smaller documents go: counts, spans and the digest of what stays."""
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), with_kept=False)


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token groups of two tokenizers, links between their ids, and how these stand in the whole corpus."""
    return token_alignment.align(_table(spark, sf_dir, "documents"))


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word shingles, similarity 0.8: doc_id, n_shingles, component_id, kept."""
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"), words=2, num=8, den=10)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable embedding on the first four whitened components; a deviation beyond 64 bits is null."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_ngram_jaccard_join,
        op3_line_dedup,
        op4_toxicity,
        op5_quality_rules,
        op6_best_fit_packing,
        op7_token_counts,
        op8_document_fingerprints,
        op9_mix_sources,
        op10_suffix_dedup,
        op11_cross_tokenizer_alignment,
        op12_minhash_near_dedup,
        op13_embedding_whitening,
    )
}

_JACCARD = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT r.d, e.b FROM r JOIN e ON e.a = r.c)
SELECT d AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.d GROUP BY d
"""

_REPEATS = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, doc_id, i, h[2 * i - 1 : 2 * i + 98] AS s FROM (SELECT r, doc_id, h, unnest(range(1, len(h) // 2 - 48)) AS i FROM d)),
m AS (SELECT r, i, doc_id > min(doc_id) OVER (PARTITION BY s) AS gone FROM w),
y AS (SELECT r, unnest(range(1, len(h) // 2 + 1)) AS i, unnest(regexp_extract_all(h, '..')) AS v FROM d),
b AS (SELECT r, i, v, bool_or(coalesce(gone, false)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM y LEFT JOIN m USING (r, i)),
c AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), false) AS head FROM b),
t AS (SELECT r, count(*) AS n, count(*) FILTER (WHERE gone) AS removed, count(*) FILTER (WHERE head) AS spans, string_agg(v, '' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN t USING (r)
"""

_MINHASH = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT r.d, e.b FROM r JOIN e ON e.a = r.c)
SELECT d AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id, d = min(c) AS kept FROM r LEFT JOIN n ON n.doc_id = r.d GROUP BY d
"""

ORACLES: dict[str, str] = {
    "op2_ngram_jaccard_join": _JACCARD,
    "op3_line_dedup": line_dedup.ORACLE,
    "op5_quality_rules": quality.oracle(),
    "op9_mix_sources": mixing.oracle(),
    "op10_suffix_dedup": _REPEATS,
    "op12_minhash_near_dedup": _MINHASH,
}
