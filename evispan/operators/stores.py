"""Knowledge graphs and vector indexes over a corpus: built with their checks, written with a manifest, loaded against the same corpus."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from evispan.operators import checks, graph, search
from evispan.sources import files


def graph_faults(entities: DataFrame, relations: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """``fault, id`` over ``entity_id`` and ``assertion_id, subject_id, predicate, object_id, evidence`` (spans with chunk): ids twice, ends
    that are no entity, relations without evidence, evidence that isn't a slice of its document and inside its chunk."""
    ends = relations.select("assertion_id", F.explode(F.array("subject_id", "object_id")).alias("entity_id"))
    spans = relations.select("assertion_id", F.explode("evidence").alias("e")).select("assertion_id", "e.document_id", "e.start", "e.end", "e.text", "e.chunk_id")
    homes = chunks.select("chunk_id", F.col("document_id").alias("home"), F.col("start").alias("a"), F.col("end").alias("b"))
    inside = (F.col("home") == F.col("document_id")) & (F.col("a") <= F.col("start")) & (F.col("end") <= F.col("b"))
    found = {
        "entity twice": checks.duplicates(entities, "entity_id").select("entity_id"),
        "assertion twice": checks.duplicates(relations, "assertion_id").select("assertion_id"),
        "end is no entity": checks.orphans(ends, "entity_id", entities, "entity_id").select("assertion_id"),
        "no evidence": relations.where("coalesce(size(evidence), 0) < 1").select("assertion_id"),
        "no slice of a document": checks.bad_spans(spans.drop("chunk_id"), documents.select("document_id", "text"), "document_id").select("assertion_id"),
        "no slice of a chunk": spans.join(homes, "chunk_id", "left").where(~F.coalesce(inside, F.lit(False))).select("assertion_id"),
    }
    out = None
    for name, df in found.items():
        own = df.select(F.lit(name).alias("fault"), F.col(df.columns[0]).cast("string").alias("id"))
        out = own if out is None else out.unionAll(own)
    return out


def _refuse(faults: DataFrame) -> None:
    if bad := faults.limit(20).collect():
        raise ValueError("; ".join(f"{r['fault']}: {r['id']}" for r in bad))


class Graph:
    """A directed multigraph of checked entities and assertions; parallel assertions stay apart."""

    def __init__(self, entities: DataFrame, relations: DataFrame):
        self.entities, self.relations = entities, relations
        self.edges = relations.select(F.col("assertion_id").alias("edge_id"), F.col("subject_id").alias("src"), "predicate", F.col("object_id").alias("dst"))

    @classmethod
    def build(cls, entities: DataFrame, relations: DataFrame, documents: DataFrame, chunks: DataFrame) -> Graph:
        _refuse(graph_faults(entities, relations, documents, chunks))
        return cls(entities, relations)

    def counts(self) -> DataFrame:
        return self.entities.agg(F.count("*").alias("nodes")).crossJoin(self.relations.agg(F.count("*").alias("edges")))

    def entity(self, entity_id: str) -> DataFrame:
        return self.entities.where(F.col("entity_id") == entity_id)

    def assertion(self, assertion_id: str) -> DataFrame:
        return self.relations.where(F.col("assertion_id") == assertion_id)

    def outgoing(self, predicates: tuple[str, ...] = ()) -> DataFrame:
        return graph.adjacency(self.edges, "outgoing", predicates)

    def incoming(self, predicates: tuple[str, ...] = ()) -> DataFrame:
        return graph.adjacency(self.edges, "incoming", predicates)

    def evidence(self) -> DataFrame:
        """``edge_id, chunk_id`` of every assertion."""
        return self.relations.select(F.col("assertion_id").alias("edge_id"), F.explode("evidence.chunk_id").alias("chunk_id")).distinct()

    def snapshot(self) -> tuple[DataFrame, DataFrame]:
        """Entities and relations in order of their ids."""
        return self.entities.orderBy("entity_id"), self.relations.orderBy("assertion_id")

    def write(self, output: str, corpus: dict) -> dict:
        """To a new folder; ``corpus`` is the manifest of the ingestion it belongs to."""
        return files.write_once({"entities": self.entities, "relations": self.relations}, output, {"corpus": corpus["tables"]})


def load_graph(spark: SparkSession, directory: str, corpus: dict, documents: DataFrame, chunks: DataFrame) -> Graph:
    """What ``Graph.write`` wrote, if nothing has changed, it belongs to this corpus, and its checks hold."""
    _same(spark, directory, corpus)
    return Graph.build(spark.read.parquet(f"{directory}/entities"), spark.read.parquet(f"{directory}/relations"), documents, chunks)


def _same(spark: SparkSession, directory: str, corpus: dict) -> None:
    if changed := files.verify(spark, directory):
        raise ValueError(f"changed since written: {changed}")
    if files.manifest(spark, directory)["config"].get("corpus") != corpus["tables"]:
        raise ValueError("built over another corpus")


def build_index(chunks: DataFrame, provider: Callable[[list[str]], list[list[float]]], batch: int = 16) -> DataFrame:
    """``chunk_id, embedding`` (unit vectors) of all chunks by a provider of vectors, ``batch`` texts at a time. A wrong number of vectors, a zero
    or non-finite one is an error."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            made: list[list[float]] = []
            for a in range(0, len(pdf), batch):
                own = pdf["text"].iloc[a : a + batch].tolist()
                got = provider(own)
                if len(got) != len(own) or len({len(v) for v in got}) > 1:
                    raise ValueError("a provider gives one vector a text, all of one length")
                made += [[float(x) for x in v] for v in got]
            yield pd.DataFrame({"chunk_id": pdf["chunk_id"], "raw": made})

    raw = chunks.select("chunk_id", "text").mapInPandas(run, "chunk_id string, raw array<double>")
    return raw.select("chunk_id", search.normalize(F.col("raw")).alias("embedding"))


def write_index(index: DataFrame, output: str, corpus: dict, spec: dict) -> dict:
    return files.write_once({"vectors": index}, output, {"corpus": corpus["tables"], "spec": spec})


def load_index(spark: SparkSession, directory: str, corpus: dict, chunks: DataFrame, spec: dict) -> DataFrame:
    """What ``write_index`` wrote, if unchanged, of this corpus and provider, with just the corpus's chunks."""
    _same(spark, directory, corpus)
    if files.manifest(spark, directory)["config"].get("spec") != spec:
        raise ValueError("made by another provider")
    index = spark.read.parquet(f"{directory}/vectors")
    _refuse(checks.difference(index.select("chunk_id"), chunks.select("chunk_id")).select(F.concat_ws(" ", F.lit("chunk of one side only:"), "side").alias("fault"), F.col("chunk_id").alias("id")))
    return index
