"""Files: typed JSON lines, text and Markdown directories, TOML settings; create-only sinks with a manifest written last."""

from __future__ import annotations

import hashlib
import json
import tomllib
from dataclasses import fields, is_dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    """One typed record a line; a bad record fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``path, title, text, content_sha256, document_id`` of all .txt and .md files below a folder, a byte order mark dropped.
    Blank files and files with NUL are left to ``checks``; hidden names are skipped by Spark."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{txt,md,markdown}").load(path)
    text = F.regexp_replace(F.decode("content", "utf-8"), "^﻿", "")
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    heading = F.regexp_extract(text, r"(?m)^ {0,3}#[ \t]+(.+?)[ \t]*$", 1)
    return raw.select("path", text.alias("text"), F.when(heading != "", heading).otherwise(stem).alias("title"), F.sha2("content", 256).alias("content_sha256"), F.concat(F.lit("doc-"), F.sha2(F.concat_ws(":", F.lit("1"), stem, F.sha2("content", 256)), 256)).alias("document_id"))


def load_settings(path: str, table: str, kind: type, **overrides):
    """One TOML table as a dataclass; unknown keys and other tables are errors, overrides win."""
    with open(path, "rb") as f:
        raw = tomllib.load(f)
    if set(raw) - {table}:
        raise ValueError(f"only [{table}] may be set, not {sorted(set(raw) - {table})}")
    values = raw.get(table, {}) | {k: v for k, v in overrides.items() if v is not None}
    known = {f.name for f in fields(kind)} if is_dataclass(kind) else set()
    if set(values) - known:
        raise ValueError(f"unknown settings: {sorted(set(values) - known)}")
    return kind(**values)


def canonical_json(record: dict) -> bytes:
    """Sorted keys, no spaces, non-ASCII kept, NaN rejected, a line end behind."""
    return (json.dumps(record, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False) + "\n").encode()


def write_once(tables: dict[str, DataFrame], path: str, config: dict | None = None) -> dict:
    """Write each table to a new folder and, last, a manifest with row counts and the order-free hash of each."""
    manifest = {"config": config or {}, "tables": {}}
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
        manifest["tables"][name] = table_hash(df.sparkSession.read.parquet(f"{path}/{name}"))
    spark = next(iter(tables.values())).sparkSession
    line = canonical_json(manifest).decode()
    spark.createDataFrame([(line.strip(), hashlib.sha256(line.encode()).hexdigest())], "manifest string, sha256 string").coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")
    return manifest


def table_hash(df: DataFrame) -> dict:
    """Rows and a hash of them in any order, as one aggregate."""
    row = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}))
    got = df.agg(F.count("*").alias("rows"), F.bit_xor(row).alias("x"), F.sum(F.pmod(row, F.lit(2**31))).alias("s")).first()
    return {"rows": got["rows"], "hash": f"{(got['x'] or 0) & (2**64 - 1):016x}-{got['s'] or 0}"}


def manifest(spark: SparkSession, path: str) -> dict:
    """The manifest of a written folder."""
    return json.loads(spark.read.json(f"{path}/manifest").first()["manifest"])


def verify(spark: SparkSession, path: str) -> list[str]:
    """Names of tables that no longer equal their manifest."""
    row = spark.read.json(f"{path}/manifest").first()
    if hashlib.sha256((row["manifest"] + "\n").encode()).hexdigest() != row["sha256"]:
        return ["manifest"]
    told = json.loads(row["manifest"])["tables"]
    return [n for n, x in told.items() if table_hash(spark.read.parquet(f"{path}/{n}")) != x]
