"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from evispan.llm import bagminhash, bpe, imatch, licenses, nn_descent, packing, sharding, suffix_dedup, token_counts, toxicity


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), carry=[])
    return scored.select("doc_id", "held_out", "score", "predicted", "evidence")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(_table(spark, sf_dir, "documents"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.nearest(_table(spark, sf_dir, "embeddings"))


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edit_fingerprints(_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_license_scan, op2_toxicity, op3_best_fit_packing, op4_minhash_near_dedup, op5_sharding, op6_suffix_dedup, op7_nearest_neighbours, op8_bpe_round_trip, op9_fingerprints, op10_token_counts]
    return {f.__name__: f for f in own}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(text: str) -> str:
    """The canonical form of a licence text as a DuckDB expression."""
    out = f"regexp_replace(lower({text}), {_quoted(licenses.COPYRIGHT_LINE)}, chr(10), 'g')"
    out = rf"regexp_replace(concat(' ', regexp_replace({out}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), ' +', '  ', 'g')"
    for pair in licenses.SPELLINGS:
        a, b = (_quoted(f" {x.replace(' ', '  ')} ") for x in pair)
        out = f"replace({out}, {a}, {b})"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


def oracle_sql() -> dict[str, str]:
    known = ", ".join(f"({_quoted(name)}, {_quoted(body)})" for name, body in licenses.KNOWN)
    digests = ", ".join(f"({_quoted(name)}, {_quoted(d)})" for name, d in licenses.DIGESTS)
    return {
        "op1_license_scan": f"""
WITH known AS (SELECT digest, min(licence) AS licence FROM (
    SELECT licence, sha256({_canonical('body')}) AS digest FROM (VALUES {known}) AS k(licence, body)
    UNION ALL SELECT * FROM (VALUES {digests}) AS d(licence, digest)) GROUP BY 1),
whole AS (SELECT doc_id, CASE WHEN {_canonical('text')} <> '' THEN sha256({_canonical('text')}) END AS digest FROM documents),
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
hits AS (SELECT l.doc_id, k.licence FROM (SELECT doc_id, sha256({_canonical('line')}) AS digest FROM lines) l JOIN known k USING (digest)),
told AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT licence, ',' ORDER BY licence) AS names FROM hits GROUP BY 1)
SELECT w.doc_id, w.digest, k.licence, CAST(coalesce(t.n, 0) AS BIGINT) AS n_notices, coalesce(t.names, '') AS notices
FROM whole w LEFT JOIN known k USING (digest) LEFT JOIN told t ON t.doc_id = w.doc_id"""
    }
