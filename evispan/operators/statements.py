"""Extraction by rules from documents: statements, rules with named groups, entities, relations, mentions, issues."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from evispan.config import Rules
from evispan.functions.text import normalize_name, stable_id
from evispan.operators import extract

VERSION = "rules-1"
#: Characters of a document that one bucket of ``evidence`` stands for.
STRETCH = 2048
_ROLES = ("subject", "object", "alias")


def statement_places(text: str) -> list[tuple[int, int]]:
    """Places of the lines that state something: not blank, not a heading, not in or beside a fence. White space around is left out."""
    out, at, sign, least = [], 0, "", 0
    for line in text.splitlines(keepends=True):
        bare, first = line.strip(), at + len(line) - len(line.lstrip())
        at += len(line)
        behind = bare.lstrip(bare[:1])
        run = len(bare) - len(behind) if bare[:1] in ("`", "~") else 0
        if sign:
            sign = "" if run >= least and bare[0] == sign and not behind.strip() else sign
        elif run >= 3:
            sign, least = bare[0], run
        elif bare and not (bare[0] == "#" and len(bare) - len(behind) <= 6 and not behind[:1].strip()):
            out.append((first, first + len(bare)))
    return out


def _per_document(docs: DataFrame, key: str, text: str, rows, schema: str) -> DataFrame:
    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            yield pd.DataFrame([(k, *x) for k, body in zip(pdf[key], pdf[text]) for x in rows(body or "")], columns=names)

    schema = f"{key} {docs.schema[key].dataType.simpleString()}, {schema}"
    names = [key, *(c.split()[0] for c in schema.split(", ")[1:])]
    return docs.select(key, text).mapInPandas(run, schema)


def statements(docs: DataFrame, key: str = "document_id", text: str = "text") -> DataFrame:
    """``key, start, end, text`` of the statements of every document; a null text has none. One pass, as fences depend on the lines above."""
    return _per_document(docs, key, text, lambda body: [(a, b, body[a:b]) for a, b in statement_places(body)], "start int, end int, text string")


def evidence(places: DataFrame, chunks: DataFrame, key: str = "document_id") -> DataFrame:
    """Places (``key, start, end``) with every chunk (``chunk_id, start, end``) that holds them whole. Documents are cut into stretches and a
    chunk stands in all it touches, so a long document's places don't meet all its chunks."""
    stretch = lambda c: F.floor(c / STRETCH)
    held = chunks.select(key, "chunk_id", F.col("start").alias("c_start"), F.col("end").alias("c_end"), F.explode(F.sequence(stretch(F.col("start")), stretch(F.greatest(F.col("start"), F.col("end") - 1)))).alias("_s"))
    rows = places.withColumn("_s", stretch(F.col("start"))).join(held, [key, "_s"])
    return rows.where((F.col("c_start") <= F.col("start")) & (F.col("end") <= F.col("c_end"))).drop("_s", "c_start", "c_end")


def matches(docs: DataFrame, chunks: DataFrame, rules: Rules, key: str = "document_id", text: str = "text") -> DataFrame:
    """Statements with the only rule that matches them whole, what it captures (``subject, subject_at`` and so on), or the ``issue``:
    ``uncovered_statement`` (in no chunk), ``unmatched_statement``, ``multiple_rules``, ``invalid_capture`` (a needed group is blank)."""
    kinds = [(r, re.compile(r.pattern)) for r in rules.rules]

    def rows(body):
        for a, b in statement_places(body):
            found = [(r, m) for r, p in kinds if (m := p.fullmatch(body[a:b]))]
            issue = None if len(found) == 1 else "multiple_rules" if found else "unmatched_statement"
            rule, m = found[0] if issue is None else (None, None)
            got = [x for g in _ROLES for x in ((m[g], a + m.start(g)) if m and g in m.groupdict() and m[g] is not None else (None, None))]
            if m and not all((m[g] or "").strip() for g in _ROLES[: 2 if rule.predicate else 1]):
                issue = "invalid_capture"
            yield (a, b, body[a:b], issue, *([rule.rule_id, rule.predicate, rule.subject_type, rule.object_type, rule.declares_subject] if rule else [None] * 5), *got)

    captured = ", ".join(f"{g} string, {g}_at int" for g in _ROLES)
    out = _per_document(docs, key, text, rows, f"start int, end int, text string, issue string, rule_id string, predicate string, subject_type string, object_type string, declares boolean, {captured}")
    homes = evidence(out.select(key, "start", "end"), chunks, key).select(key, "start", "end").distinct().withColumn("_home", F.lit(True))
    return out.join(homes, [key, "start", "end"], "left").withColumn("issue", F.when(F.col("_home").isNull(), "uncovered_statement").otherwise(F.col("issue"))).drop("_home")


def _candidates(entities: DataFrame) -> DataFrame:
    """``entity_type, surface, entity_id``: what a name or alias may mean among entities of a type."""
    return entities.select("entity_type", "entity_id", F.explode(F.array_union(F.array("name"), "aliases")).alias("n")).select("entity_type", normalize_name(F.col("n")).alias("surface"), "entity_id").distinct()


def entities_of(found: DataFrame) -> DataFrame:
    """Entities of matched statements: declared ones with their aliases, then typed references that nothing declared means."""
    ok = found.where("issue IS NULL")
    declared = extract.registry(ok.where("declares").select(F.col("subject_type").alias("entity_type"), F.col("subject").alias("name"), F.when(F.length("alias") > 0, F.col("alias")).alias("alias")))
    named = ok.select(F.explode(F.array(F.struct(F.col("subject_type").alias("entity_type"), F.col("subject").alias("name")), F.struct(F.col("object_type").alias("entity_type"), F.col("object").alias("name")))).alias("x")).select("x.*").where("entity_type IS NOT NULL AND name IS NOT NULL").distinct()
    new = named.withColumn("surface", normalize_name(F.col("name"))).join(_candidates(declared), ["entity_type", "surface"], "left_anti").select("entity_type", "name")
    return declared.unionByName(extract.registry(new))


def resolve(found: DataFrame, entities: DataFrame, key: str = "document_id") -> DataFrame:
    """A row an end of a matched statement: ``role, entity_id`` or the issue ``unknown_entity`` or ``ambiguous_entity``. A declared subject means
    itself; an end of no stated type may mean any entity of its name."""
    end = lambda g, kind: F.struct(F.lit(g).alias("role"), F.col(g).alias("name"), F.col(f"{g}_at").alias("at"), F.col(kind).alias("kind"), (F.lit(g == "subject") & F.col("declares")).alias("own"))
    ok = found.where("issue IS NULL")
    ends = ok.select(key, "start", "end", "text", "predicate", F.explode(F.array(end("subject", "subject_type"), end("object", "object_type"))).alias("e")).select(key, "start", "end", "text", "predicate", "e.*").where("role = 'subject' OR predicate IS NOT NULL")
    ends = ends.withColumn("surface", normalize_name(F.col("name")))
    meant = _candidates(entities)
    by_kind = meant.groupBy(F.col("entity_type").alias("kind"), "surface").agg(F.min("entity_id").alias("k_id"), F.count_distinct("entity_id").alias("k_n"))
    by_name = meant.groupBy("surface").agg(F.min("entity_id").alias("a_id"), F.count_distinct("entity_id").alias("a_n"))
    rows = ends.join(by_kind, ["kind", "surface"], "left").join(by_name, "surface", "left")
    n = F.when(F.col("own"), 1).when(F.col("kind").isNull(), F.coalesce("a_n", F.lit(0))).otherwise(F.coalesce("k_n", F.lit(0)))
    which = F.when(F.col("own"), stable_id("entity", F.col("kind"), F.col("surface"))).when(F.col("kind").isNull(), F.col("a_id")).otherwise(F.col("k_id"))
    issue = F.when(n == 0, "unknown_entity").when(n > 1, "ambiguous_entity")
    return rows.select(key, "start", "end", "text", "predicate", "role", "name", "at", F.when(n == 1, which).alias("entity_id"), issue.alias("issue"))


def _mentions(said: DataFrame, found: DataFrame, ends: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """Places of names in statements with the entities they may mean: those of the rule that captured the place, else those of the name."""
    taken = ends.where("entity_id IS NOT NULL").select(key, F.col("at").alias("start"), (F.col("at") + F.length("name")).alias("end"), "entity_id")
    alias = found.where("issue IS NULL AND declares AND alias IS NOT NULL AND length(alias) > 0").select(key, F.col("alias_at").alias("start"), (F.col("alias_at") + F.length("alias")).alias("end"), stable_id("entity", F.col("subject_type"), normalize_name(F.col("subject"))).alias("entity_id"))
    owned = taken.unionByName(alias).distinct()
    known = extract.surfaces(entities)
    runs = extract._runs(said.withColumnRenamed("start", "at"), key, "text", extract._longest(known), r"\w", ["at"])
    free = runs.join(known, "surface").select(key, (F.col("at") + F.col("start")).alias("start"), (F.col("at") + F.col("end")).alias("end"), "candidates")
    free = free.join(owned.select(key, "start", "end").distinct(), [key, "start", "end"], "left_anti")
    return owned.select(key, "start", "end", F.array("entity_id").alias("candidates")).unionByName(free)


def extract_rules(docs: DataFrame, chunks: DataFrame, rules: Rules, key: str = "document_id", text: str = "text", cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> dict[str, DataFrame]:
    """What the rules, and nothing else, say of documents: ``entities``; ``relations`` (``assertion_id, subject_id, predicate, object_id``, the
    statement's place); ``mentions`` and ``evidence`` with their chunks; ``issues`` (``key, start, end, issue, detail``).

    A place named by a rule belongs to what that rule says of it; elsewhere a name of several entities is an ``ambiguous_mention``. Empty tables give
    empty tables; a row repeated with id and text counts once. ``cut`` is applied to the matched statements, which most of the tables read: give it
    a function that writes and reads again (a table, a checkpoint) where the documents shouldn't be scanned for each.
    """
    version = f"{VERSION}:{rules.fingerprint()}"
    found = cut(matches(docs.dropDuplicates([key, text]), chunks, rules, key, text))
    entities = entities_of(found)
    ends = resolve(found, entities, key)
    side = lambda role: ends.where((F.col("role") == role) & F.col("entity_id").isNotNull() & F.col("predicate").isNotNull())
    both = side("subject").select(key, "start", "end", "text", "predicate", F.col("entity_id").alias("subject_id")).join(side("object").select(key, "start", "end", F.col("entity_id").alias("object_id")), [key, "start", "end"])
    relations = both.withColumn("assertion_id", stable_id("assertion", F.lit(version), F.col(key), F.col("start"), F.col("end"), F.col("text"), F.col("subject_id"), F.col("predicate"), F.col("object_id")))
    places = _mentions(found.select(key, "start", "text"), found, ends, entities, key)
    one = places.where(F.size("candidates") == 1).select(key, "start", "end", F.element_at("candidates", 1).alias("entity_id"))
    held = evidence(places.where(F.size("candidates") > 1).select(key, "start", "end"), chunks, key).select(key, "start", "end").distinct()
    issues = found.where("issue IS NOT NULL").select(key, "start", "end", "issue", F.lit(None).cast("string").alias("detail"))
    issues = issues.unionByName(ends.where("issue IS NOT NULL").select(key, "start", "end", "issue", F.concat_ws(": ", "role", "name").alias("detail")))
    issues = issues.unionByName(held.select(key, "start", "end", F.lit("ambiguous_mention").alias("issue"), F.lit(None).cast("string").alias("detail")))
    return {
        "entities": entities,
        "relations": relations.select("assertion_id", "subject_id", "predicate", "object_id", key, "start", "end", "text"),
        "evidence": evidence(relations.select("assertion_id", key, "start", "end"), chunks, key),
        "mentions": evidence(one.distinct(), chunks, key).distinct(),
        "issues": issues,
    }
