"""Answers and model proposals: strict JSON, citations against shown sources, requests, replay from receipts."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from evispan.functions.text import occurrences


def strict_json(text: str) -> dict:
    """An object without repeated keys and without NaN or infinities; else ValueError."""

    def unique(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("a key is repeated")
        return dict(pairs)

    def constant(name):
        raise ValueError(name)

    out = json.loads(text, object_pairs_hook=unique, parse_constant=constant)
    if not isinstance(out, dict):
        raise ValueError("not an object")
    return out


def parse(proposals: DataFrame, fields: set[str], key: str = "id", text: str = "response") -> DataFrame:
    """``id, ok, issue`` of each response: a strict object with just the fields asked for."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            issues = []
            for body in pdf[text]:
                try:
                    got = strict_json(body or "")
                    issues.append(None if set(got) == fields else "invalid_fields")
                except ValueError:
                    issues.append("invalid_json")
            yield pd.DataFrame({key: pdf[key], "ok": [i is None for i in issues], "issue": issues})

    return proposals.select(key, text).mapInPandas(run, f"{key} {proposals.schema[key].dataType.simpleString()}, ok boolean, issue string")


def validate_citations(citations: DataFrame, sources: DataFrame, answer: str = "answer_id") -> DataFrame:
    """``answer, citations, valid``: every quote lies exactly once (overlaps counted) in the source shown to that answer; one
    unknown source, wrong or repeated citation makes the whole answer invalid."""
    n = citations.join(sources.select(answer, "source_id", F.col("text").alias("body")), [answer, "source_id"], "left").withColumn("hits", F.coalesce(occurrences(F.col("body"), F.col("quote")), F.lit(0)))
    per = n.groupBy(answer).agg(F.count("*").alias("citations"), F.bool_and(F.col("hits") == 1).alias("each"), F.count_distinct("source_id", "quote").alias("kinds"))
    return per.select(answer, "citations", (F.col("each") & (F.col("kinds") == F.col("citations"))).alias("valid"))


def quote_spans(quotes: DataFrame, pages: DataFrame, by: str = "doc_id") -> DataFrame:
    """Quotes with their only place in the page: ``start, end``; null where they are missing or repeated."""
    rows = quotes.join(pages.select(by, F.col("text").alias("body")), by)
    once = occurrences(F.col("body"), F.col("quote")) == 1
    start = F.when(once, F.instr(F.col("body"), F.col("quote")) - 1)
    return rows.select(*quotes.columns, start.alias("start"), (start + F.length("quote")).alias("end"))


def complete(requests: DataFrame, provider: Callable[[str], str], cache: DataFrame | None = None, text: str = "request") -> DataFrame:
    """Responses to requests, by content: those in ``cache`` (``request_sha256, response``) are replayed, only others reach the
    provider, each distinct request once."""
    keyed = requests.withColumn("request_sha256", F.sha2(text, 256))
    new = keyed.select("request_sha256", text).dropDuplicates(["request_sha256"])
    new = new if cache is None else new.join(cache, "request_sha256", "left_anti")

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            yield pd.DataFrame({"request_sha256": pdf["request_sha256"], "response": [provider(x) for x in pdf[text]]})

    made = new.mapInPandas(run, "request_sha256 string, response string")
    return keyed.join(made if cache is None else made.unionByName(cache.select("request_sha256", "response")), "request_sha256")


def render_context(pieces: DataFrame, by: list[str]) -> DataFrame:
    """``[doc:start:end]`` and text of each piece in rank order, parted by blank lines."""
    piece = F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit(":"), F.col("start").cast("string"), F.lit(":"), F.col("end").cast("string"), F.lit("]\n"), F.col("text"))
    return pieces.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "start", piece.alias("p")))), lambda x: x["p"]), "\n\n").alias("context"))
