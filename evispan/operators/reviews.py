"""Reviews by people: pending sheets, faults of what they declare, counts, packets to read from, coverage of a corpus."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from evispan.operators import checks
from evispan.operators.proposals import numbered_spans

# What a reviewer of a question, and of a case of extraction, attests.
QUESTION_CHECKS = ("source_checked", "answer_supported", "evidence_complete", "alternatives_checked", "document_count_checked", "reasoning_hops_checked")
CASE_CHECKS = ("source_support", "endpoint_direction_and_predicate", "ontology_interpretation", "negative_label_complete")
_DECISIONS = ("pending", "approved", "revise")


def pending(subjects: DataFrame, key: str, attested: tuple[str, ...] = QUESTION_CHECKS) -> DataFrame:
    """A sheet with a pending row a subject; whoever reviews edits a copy."""
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    return subjects.select(key).distinct().select(key, F.lit("pending").alias("decision"), none("string", "reviewer"), none("date", "reviewed_on"), F.lit(False).alias("independent"), F.struct(*[none("boolean", c) for c in attested]).alias("checks"), none("string", "notes"))


def faults(reviews: DataFrame, subjects: DataFrame, key: str, notes_pending: bool = True) -> DataFrame:
    """``fault, key``: subjects without a row or with two, rows of none, pending rows that attest something (``notes_pending``: notes are no
    attestation), decided ones without reviewer, date or notes, approved ones without every check or by the author."""
    said = [F.col(f"checks.{c}") for c in reviews.schema["checks"].dataType.names]
    anything = lambda cols: [c.isNotNull() for c in cols]
    some = lambda xs: F.exists(F.array(*xs), lambda x: x)
    blank = lambda c: F.coalesce(F.length(F.trim(c)) == 0, F.lit(True))
    attests = some([*anything([F.col("reviewer"), F.col("reviewed_on"), *said]), F.coalesce("independent", F.lit(False)), *([] if notes_pending else anything([F.col("notes")]))])
    partial = some([blank("reviewer"), F.col("reviewed_on").isNull(), blank("notes")])
    unsure = some([~F.coalesce("independent", F.lit(False)), *(~F.coalesce(c, F.lit(False)) for c in said)])
    decided = F.col("decision").isin("approved", "revise")
    what = F.when(~F.coalesce(F.col("decision").isin(*_DECISIONS), F.lit(False)), "no decision").when((F.col("decision") == "pending") & attests, "pending but attested").when(decided & partial, "no reviewer, date or notes").when((F.col("decision") == "approved") & unsure, "approved without every check")
    own = reviews.select(key, what.alias("fault")).where("fault IS NOT NULL")
    ids = subjects.select(key).distinct()
    tell = lambda df, w: df.select(key, F.lit(w).alias("fault"))
    return own.unionAll(tell(checks.duplicates(reviews, key), "reviewed twice")).unionAll(tell(ids.join(reviews.select(key), key, "left_anti"), "not reviewed")).unionAll(tell(reviews.join(ids, key, "left_anti"), "unknown"))


def decisions(reviews: DataFrame, held_out: bool = False) -> DataFrame:
    """One row of counts. Who the reviewer is, and whether they are independent, is as declared."""
    n = lambda d: F.count_if(F.col("decision") == d)
    return reviews.agg(*[n(d).alias(d) for d in _DECISIONS], F.count("*").alias("subjects"), (n("approved") == F.count("*")).alias("all_approved"), F.lit(False).alias("reviewer_identity_authenticated"), (F.count("*") if held_out else F.lit(0).cast("long")).alias("held_out"))


def packet(cases: DataFrame, chunks: DataFrame, selection: str = "full") -> DataFrame:
    """Cases (``case_id, chunk_id``, further columns) with the numbered sentences of their chunk, as a model was shown them; null where the
    chunk is unknown."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            spans = [[{"sentence_id": i, "text": t[a:b]} for i, (a, b) in enumerate(numbered_spans(t, selection), 1)] for t in pdf["text"]]
            yield pd.DataFrame({"chunk_id": pdf["chunk_id"], "sentences": spans})

    kind = chunks.schema["chunk_id"].dataType.simpleString()
    shown = chunks.select("chunk_id", F.coalesce("text", F.lit("")).alias("text")).join(cases.select("chunk_id").distinct(), "chunk_id", "left_semi")
    return cases.join(shown.mapInPandas(run, f"chunk_id {kind}, sentences array<struct<sentence_id:int,text:string>>"), "chunk_id", "left")


def packet_changed(saved: DataFrame, current: DataFrame) -> DataFrame:
    """Rows in which a packet that was reviewed differs from one made now: empty if it is still of this source and these cases."""
    cols = sorted(current.columns)
    return checks.difference(saved.select(*cols), current.select(*cols))


def audit(documents: DataFrame, chunks: DataFrame, questions: DataFrame, gold: DataFrame, scores: DataFrame, kinds: tuple[str, ...] = (), question: str = "question_id", doc: str = "doc_id") -> DataFrame:
    """``what, value, n``: documents, chunks, questions, documents that hold evidence, questions whose evidence all chunks together don't
    hold (``scores``: ``question, complete`` over all chunks), and questions by each column of ``kinds``."""
    row = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), F.lit(None).cast("string").alias("value"), "n")
    covered = scores.where("complete").select(question).distinct()
    out = row(documents, "documents").unionAll(row(chunks, "chunks")).unionAll(row(questions, "questions")).unionAll(row(gold.select(doc).distinct(), "documents with evidence")).unionAll(row(questions.join(covered, question, "left_anti"), "uncovered questions"))
    for c in kinds:
        out = out.unionAll(questions.groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(c).alias("what"), "value", "n"))
    return out


def graph_audit(paths: DataFrame, links: DataFrame, entities: DataFrame, relations: DataFrame, query: str = "query_id") -> dict[str, DataFrame]:
    """What a query's answer by graph rests on: the assertions of its paths (``query, nodes, edges``), and the entities of paths and links
    (``query, candidates``)."""
    edges = paths.select(query, F.explode("edges").alias("assertion_id")).distinct()
    nodes = paths.select(query, F.explode("nodes").alias("entity_id")).unionAll(links.select(query, F.explode("candidates").alias("entity_id"))).distinct()
    return {"assertions": edges.join(relations, "assertion_id"), "entities": nodes.join(entities, "entity_id")}
