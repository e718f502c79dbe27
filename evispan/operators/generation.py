"""Answers with citations by a supplied provider: requests, receipts, validation, replay without a provider, rendering."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from evispan.operators.answers import strict_json
from evispan.operators.runs import render_sources
from evispan.sources.files import canonical_json

INSTRUCTIONS = """Answer the question from the numbered sources only. Reply with one JSON object and nothing else:
{"status": "answered", "claims": [{"text": "...", "citations": [{"source_id": "S1", "quote": "..."}]}]}.
Each claim cites one or more quotes, copied exactly, that occur once in their source. Where the sources do not answer the whole question, reply
{"status": "insufficient_evidence", "claims": []}."""


def make_request(query: str, pieces: list[tuple]) -> dict:
    """Messages for a provider; the sources stand in it as they were counted."""
    body = '{"question":' + json.dumps(query, ensure_ascii=False) + ',"sources":' + (render_sources(pieces) if pieces else "[]") + "}"
    return {"query": query, "messages": [{"role": "system", "content": INSTRUCTIONS}, {"role": "user", "content": body}]}


def fingerprint(request: dict, settings: dict) -> str:
    """Digest of a request and of the settings and model it is for."""
    return hashlib.sha256(canonical_json(settings) + canonical_json(request)).hexdigest()


def _refused(issue: str, detail: str) -> dict:
    return {"status": "invalid", "issue": issue, "detail": detail[:240], "claims": []}


def _proposal(text: str) -> dict:
    got = strict_json(text)
    if set(got) != {"status", "claims"} or got["status"] not in ("answered", "insufficient_evidence") or not isinstance(got["claims"], list):
        raise ValueError("status and claims are needed, and no more")
    if (got["status"] == "answered") != bool(got["claims"]):
        raise ValueError("an answer has claims, a refusal none")
    for claim in got["claims"]:
        if not isinstance(claim, dict) or set(claim) != {"text", "citations"} or not isinstance(claim["text"], str) or not claim["text"].strip() or not isinstance(claim["citations"], list) or not claim["citations"]:
            raise ValueError("a claim has a text and citations")
        for c in claim["citations"]:
            if not isinstance(c, dict) or set(c) != {"source_id", "quote"} or not all(isinstance(x, str) and x.strip() for x in c.values()):
                raise ValueError("a citation has a source and a quote")
    return got


def validate(pieces: list[tuple], response: str | None, finished: str = "stop") -> dict:
    """An answer of a response: its claims with the quotes' places in documents, or why it is refused. One fault refuses it whole.

    ``pieces``: (document, start, end, text, chunk) as shown. Without pieces there must be no response, and the evidence is insufficient."""
    if bool(pieces) != (response is not None):
        raise ValueError("a context has a response, an empty one none")
    if not pieces:
        return {"status": "insufficient_evidence", "issue": None, "detail": None, "claims": []}
    if finished == "length":
        return _refused("output_limit", "the response was cut")
    try:
        got = _proposal(response)
    except (ValueError, RecursionError) as e:
        return _refused("invalid_response", str(e))
    shown, claims = {f"S{i}": p for i, p in enumerate(pieces, 1)}, []
    for claim in got["claims"]:
        spans: dict[tuple[str, str], dict] = {}
        for c in claim["citations"]:
            source, quote = c["source_id"], c["quote"]
            if source not in shown or (source, quote) in spans:
                return _refused("invalid_citation", "unknown source" if source not in shown else "cited twice in one claim")
            doc, start, _, text, chunk = shown[source]
            places = [m.start() for m in re.finditer(f"(?={re.escape(quote)})", text)]
            if len(places) != 1:
                return _refused("invalid_citation", f"the quote occurs {len(places)} times")
            at = start + places[0]
            spans[source, quote] = {"source_id": source, "doc_id": str(doc), "chunk_id": str(chunk), "start": at, "end": at + len(quote), "quote": quote}
        claims.append({"text": claim["text"], "citations": list(spans.values())})
    return {"status": got["status"], "issue": None, "detail": None, "claims": claims}


_ANSWER = "status string, issue string, detail string, claims array<struct<text:string,citations:array<struct<source_id:string,doc_id:string,chunk_id:string,start:int,end:int,quote:string>>>>"


def requests(contexts: DataFrame, settings: dict, key: str = "question_id", query: str = "query") -> DataFrame:
    """``key, request, request_sha256`` of contexts (``key, query, pieces`` as ``runs.contexts`` gives them); null where there is no piece."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            made = [make_request(q, _tuples(p)) for q, p in zip(pdf[query], pdf["pieces"])]
            has = [len(_tuples(p)) > 0 for p in pdf["pieces"]]
            yield pd.DataFrame({key: pdf[key], "request": [canonical_json(m).decode() if h else None for m, h in zip(made, has)], "request_sha256": [fingerprint(m, settings) if h else None for m, h in zip(made, has)]})

    return contexts.select(key, query, "pieces").mapInPandas(run, f"{key} {contexts.schema[key].dataType.simpleString()}, request string, request_sha256 string")


def _tuples(pieces) -> list[tuple]:
    return [tuple(p[c] for c in ("doc_id", "start", "end", "text", "chunk_id")) for p in (pieces if pieces is not None else [])]


def generate(asked: DataFrame, provider: Callable[[str], str], receipts: DataFrame | None = None) -> DataFrame:
    """``request_sha256, response`` of every distinct request: from ``receipts`` where they have it, else by the provider, once."""
    new = asked.where("request IS NOT NULL").select("request_sha256", "request").dropDuplicates(["request_sha256"])
    new = new if receipts is None else new.join(receipts, "request_sha256", "left_anti")

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            yield pd.DataFrame({"request_sha256": pdf["request_sha256"], "response": [provider(x) for x in pdf["request"]]})

    made = new.mapInPandas(run, "request_sha256 string, response string")
    return made if receipts is None else made.unionByName(receipts.select("request_sha256", "response"))


def replay(contexts: DataFrame, receipts: DataFrame, settings: dict, key: str = "question_id", query: str = "query") -> DataFrame:
    """Answers from receipts alone: requests are made anew, so a changed source, prompt or setting finds no receipt, which is an error."""
    asked = requests(contexts, settings, key, query).join(receipts.select("request_sha256", "response"), "request_sha256", "left")
    lost = F.col("request").isNotNull() & F.col("response").isNull()
    asked = asked.select(key, F.when(lost, F.raise_error(F.lit("no receipt for a request")).cast("string")).otherwise(F.col("response")).alias("response"))
    rows = contexts.select(key, "pieces").join(asked, key)

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            got = [validate(_tuples(p), r if isinstance(r, str) else None) for p, r in zip(pdf["pieces"], pdf["response"])]
            yield pd.DataFrame({key: pdf[key], **{c: [g[c] for g in got] for c in ("status", "issue", "detail", "claims")}})

    return rows.mapInPandas(run, f"{key} {contexts.schema[key].dataType.simpleString()}, {_ANSWER}")


def render_answer(query: str, answer: dict) -> str:
    """An answer as Markdown, with its sources in order of first use; signs that Markdown reads are escaped."""
    safe = lambda s: re.sub(r"([\\`*_\[\]<>#|])", r"\\\1", s.replace("\n", " "))
    lines = [f"# {safe(query)}", "", f"Status: {answer['status'].replace('_', ' ')}", ""]
    order = list(dict.fromkeys((c["doc_id"], c["start"], c["end"], c["quote"]) for claim in answer["claims"] for c in claim["citations"]))
    for claim in answer["claims"]:
        marks = sorted(order.index((c["doc_id"], c["start"], c["end"], c["quote"])) + 1 for c in claim["citations"])
        lines.append(f"- {safe(claim['text'])} " + "".join(f"[{m}]" for m in marks))
    lines += ["", *(f"{i}. {safe(d)}, {a} to {b}: \"{safe(q)}\"" for i, (d, a, b, q) in enumerate(order, 1))] if order else []
    return "\n".join(lines).rstrip() + "\n"
