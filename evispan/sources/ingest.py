"""A folder of texts to documents, sections and chunks: read, checked, written with a manifest, and read again with its checks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from evispan.operators import checks, chunking
from evispan.sources import files

PARSER = "1"
_SUFFIX = r"(?i)\.(txt|md|markdown)$"


def discover(spark: SparkSession, root: str) -> DataFrame:
    """``relative_path, content, supported`` of every file below a folder that Spark lists (names with a dot before them are hidden)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    top = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(at).toString().rstrip("/") + "/"
    return found.select(F.expr("substring(path, %d)" % (len(top) + 1)).alias("relative_path"), "content", F.col("path").rlike(_SUFFIX).alias("supported"))


def parse_bytes(raw: bytes, relative_path: str) -> dict:
    """A document of a file's bytes: its text without byte order mark, title, id and sections; ``issue`` instead where there is none.

    The title is the first heading of level 1, else the file's stem. The id binds parser, path and text. Nothing else is rewritten."""
    try:
        text = raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        return {"issue": "not UTF-8"}
    if not text.strip():
        return {"issue": "blank"}
    if "\0" in text:
        return {"issue": "has NUL"}
    parts = [(0, len(text), None)] if relative_path.lower().endswith(".txt") else chunking.sections(text)
    top = [label for _, _, label in parts if label is not None and " / " not in label and _level(text, parts, label) == 1]
    stem = relative_path.rsplit("/", 1)[-1].rsplit(".", 1)[0].strip()
    digest = hashlib.sha256(text.encode()).hexdigest()
    name = json.dumps([PARSER, relative_path, digest], separators=(",", ":"))
    return {"issue": None, "document_id": "doc-" + hashlib.sha256(name.encode()).hexdigest(), "title": top[0] if top else stem or "Untitled document", "text": text, "content_sha256": digest, "sections": parts}


def _level(text: str, parts: list, label: str) -> int:
    start = next(a for a, _, own in parts if own == label)
    return chunking.heading(text[start:].splitlines()[0])[0]


_DOCUMENT = "relative_path string, issue string, document_id string, title string, text string, content_sha256 string, raw_sha256 string, sections array<struct<start:int,end:int,label:string>>"


def documents(spark: SparkSession, root: str) -> DataFrame:
    """A row a supported file; ``issue`` tells why one gives no document."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in _DOCUMENT.replace(", ", "\n").split("\n")]
        for pdf in pdfs:
            rows = []
            for path, raw in zip(pdf["relative_path"], pdf["content"]):
                got = parse_bytes(bytes(raw), path)
                got["sections"] = [dict(zip(("start", "end", "label"), s)) for s in got["sections"]] if not got["issue"] else None
                rows.append([{"relative_path": path, "raw_sha256": hashlib.sha256(raw).hexdigest(), **got}.get(n) for n in names])
            yield pd.DataFrame(rows, columns=names)

    return discover(spark, root).where("supported").select("relative_path", "content").mapInPandas(run, _DOCUMENT)


def ingest(spark: SparkSession, root: str, config: chunking.Chunking = chunking.Chunking()) -> dict[str, DataFrame]:
    """``documents`` and ``chunks`` of a folder. A file that gives no document, or a folder without files, is an error that names it."""
    docs = documents(spark, root)
    bad = docs.where("issue IS NOT NULL").select("relative_path", "issue").orderBy("relative_path").limit(20).collect()
    if bad:
        raise ValueError("; ".join(f"{r['relative_path']}: {r['issue']}" for r in bad))
    if not docs.limit(1).count():
        raise ValueError(f"no texts below {root}")
    docs = docs.drop("issue")
    return {"documents": docs, "chunks": chunking.chunk(docs, config, "document_id")}


def outside(source: str, output: str) -> None:
    """An output folder must not lie in its source."""
    a, b = (x.rstrip("/") + "/" for x in (source, output))
    if b.startswith(a):
        raise ValueError("the output lies in its source")


def ingest_to_directory(spark: SparkSession, root: str, output: str, config: chunking.Chunking = chunking.Chunking()) -> dict:
    """Write what ``ingest`` gives to a new folder, the manifest last."""
    outside(root, output)
    return files.write_once(ingest(spark, root, config), output, {"parser": PARSER, "chunker": chunking.VERSION, **asdict(config)})


def faults(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """``fault, id`` of whatever doesn't hold: ids twice, texts that aren't their digest's, sections that don't partition a text, chunks
    that aren't their text's slice or lie across sections, places out of order, documents without chunk."""
    rows = docs.select("document_id", F.posexplode("sections").alias("i", "s"), F.length("text").alias("n"))
    w = Window.partitionBy("document_id").orderBy("i")
    broken = rows.withColumn("from", F.coalesce(F.lag("s.end").over(w), F.lit(0))).withColumn("last", F.lead("i").over(w).isNull())
    broken = broken.where((F.col("s.start") != F.col("from")) | (F.col("s.end") <= F.col("s.start")) | (F.col("last") & (F.col("s.end") != F.col("n"))))
    inside = F.exists("sections", lambda s: (s["start"] <= F.col("start")) & (F.col("end") <= s["end"]) & s["label"].eqNullSafe(F.col("section")))
    found = {
        "document twice": checks.duplicates(docs, "document_id").select("document_id"),
        "chunk twice": checks.duplicates(chunks, "chunk_id").select("chunk_id"),
        "text changed": checks.changed(docs, "text", "content_sha256").select("document_id"),
        "sections broken": broken.select("document_id"),
        "no slice": checks.bad_spans(chunks, docs.select("document_id", "text"), "document_id").select("chunk_id"),
        "across sections": chunks.join(docs.select("document_id", "sections"), "document_id").where(~inside).select("chunk_id"),
        "out of order": checks.gaps_in_order(chunks, "document_id").select("chunk_id"),
        "no chunk": checks.orphans(docs.select("document_id"), "document_id", chunks, "document_id"),
    }
    out = None
    for name, df in found.items():
        own = df.select(F.lit(name).alias("fault"), F.col(df.columns[0]).cast("string").alias("id"))
        out = own if out is None else out.unionAll(own)
    return out


def load(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    """What was written, after its manifest and all checks hold; else an error that names what doesn't."""
    if changed := files.verify(spark, directory):
        raise ValueError(f"changed since written: {changed}")
    got = {n: spark.read.parquet(f"{directory}/{n}") for n in ("documents", "chunks")}
    bad = faults(got["documents"], got["chunks"]).limit(20).collect()
    if bad:
        raise ValueError("; ".join(f"{r['fault']}: {r['id']}" for r in bad))
    return got
