"""Rule extraction and linking: statements against rules, names and aliases, relations, mentions, query links."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from evispan.functions.text import normalize_name, stable_id


def match_rules(statements: DataFrame, rules: list[dict]) -> DataFrame:
    """Statements with each rule that matches them whole: ``rule_id, predicate, subject, object`` and ``issue``.

    ``rules``: dicts of rule_id, pattern with two groups (subject, object), predicate, subject_type, object_type. Exactly one
    match makes a row without issue; none is ``unmatched_statement``, several ``multiple_rules``. The rules are a
    configured list, so they become expressions of one pass; nothing is joined.
    """
    hits = F.filter(F.array(*[F.when(F.col("statement").rlike(f"^(?:{r['pattern']})$"), F.struct(F.lit(r["rule_id"]).alias("rule_id"), F.lit(r["predicate"]).alias("predicate"), F.lit(r["subject_type"]).alias("subject_type"), F.lit(r["object_type"]).alias("object_type"), F.regexp_extract("statement", f"^(?:{r['pattern']})$", 1).alias("subject"), F.regexp_extract("statement", f"^(?:{r['pattern']})$", 2).alias("object"))) for r in rules]), lambda x: x.isNotNull())
    rows = statements.withColumn("_h", hits).withColumn("_m", F.when(F.size("_h") == 1, F.element_at("_h", 1)))
    issue = F.when(F.size("_h") == 0, "unmatched_statement").when(F.size("_h") > 1, "multiple_rules")
    return rows.select(*statements.columns, "_m.*", issue.alias("issue"))


def registry(names: DataFrame) -> DataFrame:
    """Entities of declared names (``entity_type, name``, perhaps ``alias``): one a type and normalised name, canonical name the least,
    aliases without those that equal it, each once by normalised form."""
    rows = names if "alias" in names.columns else names.withColumn("alias", F.lit(None).cast("string"))
    rows = rows.withColumn("key", normalize_name(F.col("name")))
    own = rows.groupBy("entity_type", "key").agg(F.min("name").alias("name"), F.count("*").alias("declared"))
    alias = rows.where("alias IS NOT NULL").withColumn("akey", normalize_name(F.col("alias"))).where("akey <> key").groupBy("entity_type", "key", "akey").agg(F.min("alias").alias("alias")).groupBy("entity_type", "key").agg(F.array_sort(F.collect_list("alias")).alias("aliases"))
    out = own.join(alias, ["entity_type", "key"], "left")
    return out.select(stable_id("entity", F.col("entity_type"), F.col("key")).alias("entity_id"), "entity_type", "key", "name", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "declared")


def surfaces(entities: DataFrame) -> DataFrame:
    """Normalised names and aliases with the set of entities that each may mean."""
    rows = entities.select("entity_id", F.explode(F.array_union(F.array("name"), "aliases")).alias("s"))
    return rows.select(normalize_name(F.col("s")).alias("surface"), "entity_id").distinct().groupBy("surface").agg(F.array_sort(F.collect_list("entity_id")).alias("candidates"))


def lookup(queries: DataFrame, entities: DataFrame, name: str = "name") -> DataFrame:
    """Entities whose name or alias equals a normalised name: a hash join on it."""
    return queries.withColumn("surface", normalize_name(F.col(name))).join(surfaces(entities), "surface", "left").withColumn("ambiguous", F.coalesce(F.size("candidates") > 1, F.lit(False)))


def relations(matches: DataFrame, entities: DataFrame) -> DataFrame:
    """Assertions of matched statements whose two ends mean exactly one entity of their type, else an issue."""
    keys = entities.select(F.col("entity_type"), F.col("key"), "entity_id")

    def side(df: DataFrame, c: str) -> DataFrame:
        own = keys.select(F.col("entity_type").alias(f"{c}_type"), F.col("key").alias(f"{c}_key"), F.col("entity_id").alias(f"{c}_id"))
        return df.withColumn(f"{c}_key", normalize_name(F.col(c))).join(own, [f"{c}_type", f"{c}_key"], "left")

    out = side(side(matches.where("issue IS NULL"), "subject"), "object")
    issue = F.when(F.col("subject_id").isNull() | F.col("object_id").isNull(), "unknown_entity").when(F.col("subject_id") == F.col("object_id"), "invalid_capture")
    return out.withColumn("issue", issue).withColumn("assertion_id", F.when(issue.isNull(), stable_id("assertion", F.col("subject_id"), F.col("predicate"), F.col("object_id"))))


def _runs(rows: DataFrame, key: str, text: str, most: int, beside: str, keep: list[str]) -> DataFrame:
    """``key, start, end, surface`` (and ``keep``) of the runs of up to ``most`` words of a text, cut where no sign of ``beside`` stands
    next to them. Their number follows the text's length and the longest surface, not the number of names."""
    left, right, sign = re.compile(rf"(?<!{beside})(?=\S)"), re.compile(rf"(?<=\S)(?!{beside})"), re.compile(beside)

    def run(pdfs):
        for pdf in pdfs:
            out = []
            for row in zip(*(pdf[c] for c in (text, key, *keep))):
                body = row[0] or ""
                words = [(m.start(), m.end()) for m in re.finditer(r"\S+", body)]
                marks = sorted({p for w in words for p in w} | {m.start() for m in left.finditer(body)} | {m.end() for m in right.finditer(body)})
                for i, a in enumerate(marks):
                    if a and sign.match(body[a - 1]):
                        continue
                    for b in marks[i + 1 :]:
                        piece = body[a:b]
                        if len(piece.split()) > most:
                            break
                        if piece.strip() == piece and not (b < len(body) and sign.match(body[b])):
                            out.append((*row[1:], a, b, " ".join(piece.lower().replace("ß", "ss").split())))
            yield pd.DataFrame(out, columns=[key, *keep, "start", "end", "surface"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in (key, *keep))
    return rows.select(key, text, *keep).mapInPandas(run, f"{kinds}, start int, end int, surface string").distinct()


def _longest(known: DataFrame) -> int:
    """Words of the longest surface: one number, as both sides of the lookup must know it."""
    return known.agg(F.max(F.size(F.split("surface", " "))).alias("n")).first()["n"] or 0


def link(queries: DataFrame, entities: DataFrame, query: str = "query_id", text: str = "query") -> DataFrame:
    """Names in query texts: longest first, then leftmost, then by surface; no two overlap; no word character or hyphen next to one.
    ``query, start, surface, candidates``, places in the normalised query.

    Runs of words up to the longest surface's length are looked up by a hash join on the surface, so the cost
    follows the query's length, not the number of names; the overlap rule is a fold over one query's matches.
    """
    known = surfaces(entities)
    asked = queries.select(query, normalize_name(F.col(text)).alias(text))
    found = _runs(asked, query, text, _longest(known), r"[\w-]", []).join(known, "surface")
    order = F.array_sort(F.collect_list(F.struct((F.col("start") - F.col("end")).alias("neg"), "start", "surface", "end", "candidates")))
    zero = F.slice(F.col("ms"), 1, 0)
    free = lambda acc, m: ~F.exists(acc, lambda x: (x["start"] < m["end"]) & (m["start"] < x["end"]))
    kept = found.groupBy(query).agg(order.alias("ms")).select(query, F.explode(F.aggregate("ms", zero, lambda acc, m: F.when(free(acc, m), F.concat(acc, F.array(m))).otherwise(acc))).alias("m"))
    return kept.select(query, "m.start", "m.surface", "m.candidates")


def links(queries: DataFrame, entities: DataFrame, query: str = "query_id", text: str = "query") -> DataFrame:
    """What a query names, once a set of candidates: ``query, candidates, surfaces``."""
    return link(queries, entities, query, text).groupBy(query, "candidates").agg(F.array_sort(F.collect_set("surface")).alias("surfaces"))


def mentions(statements: DataFrame, entities: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Places of unambiguous names in texts, as ``link`` finds them."""
    return link(statements, entities, key, text).where(F.size("candidates") == 1).select(key, "start", "surface", F.element_at("candidates", 1).alias("entity_id"))


def ambiguity(entities_with_names: DataFrame, name: str, key: str) -> DataFrame:
    """Normalised names that more than one entity has."""
    return entities_with_names.select(normalize_name(F.col(name)).alias("surface"), F.col(key).alias("e")).groupBy("surface").agg(F.count_distinct("e").alias("n_entities")).where("n_entities > 1")
