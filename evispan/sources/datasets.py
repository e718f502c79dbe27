"""Question sets and fixtures: typed JSON lines, every check before a split is chosen, checks as tables of faults."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from evispan.operators import checks
from evispan.sources.files import read_jsonl

_SPAN = "struct<document_id:string,start:int,end:int,text:string,chunk_id:string>"
DOCUMENT = "document_id string, title string, text string, content_sha256 string, source_uri string"
CHUNK = "document_id string, start int, end int, text string, chunk_id string, ordinal int, section string, page int"
ENTITY = f"entity_id string, name string, entity_type string, aliases array<string>, mentions array<{_SPAN}>"
RELATION = f"assertion_id string, subject_id string, predicate string, object_id string, evidence array<{_SPAN}>, extraction_method string, extraction_version string"
QUESTION = f"question_id string, question string, question_type string, expected_answer string, sufficient_evidence_sets array<struct<facts:array<struct<fact_id:string,statement:string,spans:array<{_SPAN}>>>>>, relevant_document_ids array<string>, relevant_entity_ids array<string>, required_document_count int, reasoning_hops int, difficulty string, split string, group_id string"
# The files of a fixture, and the splits.
FILES = {"corpus/documents.jsonl": DOCUMENT, "gold/chunks.jsonl": CHUNK, "gold/entities.jsonl": ENTITY, "gold/relations.jsonl": RELATION, "gold/questions.jsonl": QUESTION, "ontology.json": "entity_types array<string>, relation_types array<string>"}
SPLITS = ("fixture", "dev", "test")


def line_faults(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``file, line, issue`` of blank lines, lines that are no record and files without lines. For reports: it takes files whole."""
    raw = spark.read.format("binaryFile").load(path)
    body = F.decode("content", "utf-8")
    lines = raw.select(F.col("path").alias("file"), F.posexplode(F.split(F.regexp_replace(body, r"\n\z", ""), "\n")).alias("line", "text"))
    record = F.from_json("text", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    issue = F.when(F.trim("text") == "", "blank line").when(record.getField("_bad").isNotNull() | record.isNull(), "no record")
    bad = lines.select("file", (F.col("line") + 1).alias("line"), issue.alias("issue")).where("issue IS NOT NULL")
    return raw.where("length(content) = 0").select(F.col("path").alias("file"), F.lit(0).alias("line"), F.lit("empty file").alias("issue")).unionAll(bad.join(raw.where("length(content) = 0").select(F.col("path").alias("file")), "file", "left_anti"))


def gold_spans(questions: DataFrame) -> DataFrame:
    """``question_id, set_id, fact_id, statement, document_id, start, end, text``: a row a span."""
    sets = questions.select("question_id", F.posexplode("sufficient_evidence_sets").alias("set_id", "s"))
    facts = sets.select("question_id", "set_id", F.explode("s.facts").alias("f"))
    return facts.select("question_id", "set_id", "f.fact_id", "f.statement", F.explode("f.spans").alias("p")).select("question_id", "set_id", "fact_id", "statement", "p.document_id", "p.start", "p.end", "p.text")


def _named(found: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in found.items():
        own = df.select(F.lit(name).alias("fault"), F.col(df.columns[0]).cast("string").alias("id"))
        out = own if out is None else out.unionAll(own)
    return out


def question_faults(documents: DataFrame, questions: DataFrame) -> DataFrame:
    """``fault, id``: ids twice, groups in several splits, facts that differ under one id, spans that aren't their document's slice, labels
    that don't follow from the spans."""
    spans = gold_spans(questions)
    fact = F.sha2(F.to_json(F.struct("f.statement", "f.spans")), 256)
    facts = questions.select("question_id", F.explode(F.flatten(F.transform("sufficient_evidence_sets", lambda s: s["facts"]))).alias("f")).select("question_id", "f.fact_id", fact.alias("body"))
    docs = spans.groupBy("question_id", "set_id").agg(F.collect_set("document_id").alias("ds")).groupBy("question_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ds")))).alias("all"), F.min(F.size("ds")).alias("least"))
    labels = questions.join(docs, "question_id", "left").where(~F.coalesce((F.array_sort("relevant_document_ids") == F.col("all")) & (F.col("required_document_count") == F.col("least")), F.lit(False)))
    return _named(
        {
            "question twice": checks.duplicates(questions, "question_id").select("question_id"),
            "unknown split": questions.where(~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False))).select("question_id"),
            "group in several splits": checks.spanning(questions, "group_id", "split").select("group_id"),
            "fact differs": checks.spanning(facts.withColumn("key", F.concat_ws("/", "question_id", "fact_id")), "key", "body").select("key"),
            "no slice": checks.bad_spans(spans, documents.select("document_id", "text"), "document_id").select("question_id"),
            "labels": labels.select("question_id"),
        }
    )


def load_benchmark(spark: SparkSession, documents_path: str, questions_path: str, split: str) -> tuple[DataFrame, DataFrame]:
    """Documents and the questions of one split, by id. All questions are checked first, whatever their split; none left is an error."""
    if split not in SPLITS:
        raise ValueError(f"no split {split}")
    documents, questions = read_jsonl(spark, documents_path, DOCUMENT), read_jsonl(spark, questions_path, QUESTION)
    bad = _named({"document twice": checks.duplicates(documents, "document_id").select("document_id"), "text changed": checks.changed(documents, "text", "content_sha256").select("document_id")})
    bad = bad.unionAll(question_faults(documents, questions)).limit(20).collect()
    if bad:
        raise ValueError("; ".join(f"{r['fault']}: {r['id']}" for r in bad))
    own = questions.where(F.col("split") == split).orderBy("question_id")
    if not own.limit(1).count():
        raise ValueError(f"no questions in {split}")
    return documents, own


def fixture_faults(t: dict[str, DataFrame]) -> DataFrame:
    """``fault, id`` over ``documents, chunks, entities, relations, questions, ontology``: ids and places twice, types and predicates that the
    ontology lacks, ends that are no entity, mentions that aren't a name of theirs, spans that aren't in their chunk."""
    kinds, predicates = (t["ontology"].select(F.explode(c).alias(k)) for c, k in (("entity_types", "entity_type"), ("relation_types", "predicate")))
    ends = t["relations"].select("assertion_id", F.explode(F.array("subject_id", "object_id")).alias("entity_id"))
    mentions = t["entities"].select("entity_id", "name", "aliases", F.explode("mentions").alias("m")).select("entity_id", "name", "aliases", "m.*")
    evidence = t["relations"].select("assertion_id", F.explode("evidence").alias("e")).select("assertion_id", "e.*")
    spans = mentions.select(F.col("entity_id").alias("id"), "document_id", "start", "end", "text", "chunk_id").unionByName(evidence.select(F.col("assertion_id").alias("id"), "document_id", "start", "end", "text", "chunk_id"))
    homes = t["chunks"].select("chunk_id", F.col("document_id").alias("home"), F.col("start").alias("a"), F.col("end").alias("b"))
    inside = (F.col("home") == F.col("document_id")) & (F.col("a") <= F.col("start")) & (F.col("end") <= F.col("b"))
    asked = t["questions"].select("question_id", F.explode("relevant_entity_ids").alias("entity_id"))
    found = {f"{k} twice": checks.duplicates(t[n], k).select(k) for n, k in (("documents", "document_id"), ("chunks", "chunk_id"), ("entities", "entity_id"), ("relations", "assertion_id"))}
    found |= {
        "place twice": checks.duplicates(t["chunks"], "document_id", "ordinal").select("document_id"),
        "unknown type": checks.orphans(t["entities"], "entity_type", kinds, "entity_type").select("entity_id"),
        "unknown predicate": checks.orphans(t["relations"], "predicate", predicates, "predicate").select("assertion_id"),
        "end is no entity": checks.orphans(ends, "entity_id", t["entities"], "entity_id").select("assertion_id"),
        "asks for no entity": checks.orphans(asked, "entity_id", t["entities"], "entity_id").select("question_id"),
        "no name": mentions.where(~((F.col("text") == F.col("name")) | F.array_contains("aliases", F.col("text")))).select("entity_id"),
        "no slice of a document": checks.bad_spans(spans.drop("chunk_id"), t["documents"].select("document_id", "text"), "document_id").select("id"),
        "no slice of a chunk": spans.where("chunk_id IS NOT NULL").join(homes, "chunk_id", "left").where(~F.coalesce(inside, F.lit(False))).select("id"),
    }
    return _named(found).unionAll(question_faults(t["documents"], t["questions"]))


def load_fixture(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of a fixture, after its manifest's digests of exactly its files, and all checks, hold."""
    told = json.loads("\n".join(r["value"] for r in spark.read.text(f"{root}/manifest.json", wholetext=True).collect()))["files"]
    if set(told) != set(FILES):
        raise ValueError("the manifest must list the files of a fixture and no others")
    for name in FILES:
        raw = spark.read.format("binaryFile").load(f"{root}/{name}").select("content").first()["content"]
        if hashlib.sha256(raw).hexdigest() != told[name]:
            raise ValueError(f"{name} has changed")
    tables = {name.rsplit("/", 1)[-1].split(".")[0]: spark.read.schema(kind).option("mode", "FAILFAST").option("multiLine", name.endswith(".json")).json(f"{root}/{name}") for name, kind in FILES.items()}
    bad = fixture_faults(tables).limit(20).collect()
    if bad:
        raise ValueError("; ".join(f"{r['fault']}: {r['id']}" for r in bad))
    return tables
