"""Extraction by rules and by a model, reviews, host memory: against plain versions, and with things tampered with."""

import json
import random
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from evispan import config
from evispan.operators import extract, proposals, reviews, statements
from evispan.plans import inputs
from evispan.sources import host

R = random.Random(11)
DOC = "document_id int, text string"
CHUNK = "chunk_id string, document_id int, start int, end int, text string"


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def chunked(spark, docs, size=None):
    """Each document as one chunk, or as chunks of ``size`` characters."""
    cut = lambda t: [(0, len(t))] if size is None else [(a, min(a + size, len(t))) for a in range(0, len(t), size)]
    return spark.createDataFrame([(f"{k}.{a}", k, a, b, t[a:b]) for k, t in docs if t for a, b in cut(t)], CHUNK)


def test_statements_skip_headings_blanks_and_fences(spark):
    text = "# Title\n\n  Ochre is a dye.  \n####### seven signs\n#tag\n```py\nx = 1\n~~~\n``\n````  \nback\n   ~~~~ info\n~~~\n# in\n~~~~~\n\t\nlast"
    got = [text[a:b] for a, b in statements.statement_places(text)]
    assert got == ["Ochre is a dye.", "####### seven signs", "#tag", "back", "last"]
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "``` never closed\nlost")], DOC)
    assert [r[1] for r in rows(statements.statements(docs), "document_id", "text")] == sorted(got)


def test_evidence_equals_plain_containment(spark):
    places = [(R.randrange(3), a, a + R.randrange(1, 4000)) for a in (R.randrange(20000) for _ in range(60))]
    held = [(f"c{i}", R.randrange(3), a, a + R.randrange(1, 9000), "") for i, a in enumerate(R.randrange(20000) for _ in range(80))]
    got = rows(statements.evidence(spark.createDataFrame(places, "document_id int, start int, end int"), spark.createDataFrame(held, CHUNK)), "document_id", "start", "end", "chunk_id")
    assert got == sorted((d, a, b, c) for d, a, b in places for c, e, x, y, _ in held if d == e and x <= a and b <= y)


RULES = config.Rules((
    config.Rule("dye", r"(?P<subject>[\w ]+?)(?: \(or (?P<alias>\w+)\))? is a dye\.", "dye", declares_subject=True),
    config.Rule("place", r"(?P<subject>[\w ]+) is a town\.", "town", declares_subject=True),
    config.Rule("from", r"(?P<subject>[\w ]+) comes from (?P<object>[\w ]*)\.", None, "town", "from"),
    config.Rule("tint", r"(?P<subject>\w+) tints (?P<object>\w+)\.", "dye", "cloth", "tints"),
    config.Rule("again", r"(?P<subject>Madder) tints .*(?P<object>wool)\.", "dye", "cloth", "tints"),
))


def test_rules(spark):
    text = "Madder (or Rubia) is a dye.\nSiena is a dye.\nSiena is a town.\nrubia tints silk.\nMadder tints wool.\nSiena comes from Siena.\nRubia comes from  .\nnobody knows, says Rubia.\nWoad comes from Siena.\nSiena rubia"
    docs = [(1, text), (2, "WELD tints silk.\n# Siena\nweld  fades"), (3, None), (1, text)]
    table = spark.createDataFrame(docs, DOC)
    out = statements.extract_rules(table, chunked(spark, docs[:2]), RULES)
    names = {r["entity_id"]: (r["entity_type"], r["name"], tuple(r["aliases"])) for r in out["entities"].collect()}
    assert sorted(names.values()) == [("cloth", "silk", ()), ("dye", "Madder", ("Rubia",)), ("dye", "Siena", ()), ("dye", "WELD", ()), ("town", "Siena", ())]
    told = [(names[r["subject_id"]][1], r["predicate"], names[r["object_id"]][1]) for r in out["relations"].collect()]
    assert sorted(told) == [("Madder", "tints", "silk"), ("WELD", "tints", "silk")]
    issue = lambda line, what: (1, text.index(line), text.index(line) + len(line), what)
    last = len(text) - len("Siena rubia")
    assert rows(out["issues"].where("issue <> 'ambiguous_mention'"), "document_id", "start", "end", "issue") == sorted([
        issue("Madder tints wool.", "multiple_rules"), issue("Siena comes from Siena.", "ambiguous_entity"), issue("Rubia comes from  .", "invalid_capture"),
        issue("nobody knows, says Rubia.", "unmatched_statement"), issue("Woad comes from Siena.", "unknown_entity"), (1, last, len(text), "unmatched_statement"),
        (2, docs[1][1].index("weld"), len(docs[1][1]), "unmatched_statement"),
    ])
    # the object of "comes from" is the town by its type, elsewhere the name alone means two
    loose = [m.start() for m in re.finditer("Siena", text)]
    assert [r[0] for r in rows(out["issues"].where("issue = 'ambiguous_mention'"), "start")] == [loose[2], loose[-1]]
    seen = {(names[r["entity_id"]][:2], r["document_id"], r["start"]) for r in out["mentions"].collect()}
    assert {s for e, d, s in seen if e == ("dye", "Madder")} == {m.start() for m in re.finditer("(?i)madder|rubia", text)}
    assert {s for e, d, s in seen if e == ("town", "Siena")} == {loose[1], loose[3], loose[4]}
    assert {(d, s) for e, d, s in seen if e == ("dye", "WELD")} == {(2, 0), (2, docs[1][1].index("weld"))}
    assert out["evidence"].count() == 2 and out["mentions"].count() == len(seen)
    split = statements.extract_rules(table, chunked(spark, docs[:2], 20), RULES)
    assert "uncovered_statement" in {r["issue"] for r in split["issues"].collect()}
    empty = statements.extract_rules(table.limit(0), chunked(spark, docs[:2]).limit(0), RULES)
    assert {k: v.count() for k, v in empty.items()} == dict.fromkeys(out, 0)


def test_links_join_surfaces_of_one_set(spark):
    e = extract.registry(spark.createDataFrame([("a", "Red Lake", "RL"), ("b", "red  lake", None), ("b", "Lake", "RL")], "entity_type string, name string, alias string"))
    got = extract.links(spark.createDataFrame([(1, "is rl near  RED\tlake, or a lake?"), (2, "redlake rl-x"), (3, None)], "query_id int, query string"), e)
    assert sorted((r["query_id"], len(r["candidates"]), tuple(r["surfaces"])) for r in got.collect()) == [(1, 1, ("lake",)), (1, 2, ("red lake",)), (1, 2, ("rl",))]


SETTINGS = config.ModelExtraction(
    config.LocalModel("some/model", "a" * 40),
    {"tool": "a thing that is used", "craft": "what is done with it"},
    (config.RelationKind("serves", "is used for", ("tool",), ("craft",)),),
)


def reply(entities, relations):
    return json.dumps({"entities": [dict(zip(("id", "name", "entity_type"), e)) for e in entities], "relations": [dict(zip(("subject", "predicate", "object", "quote"), r)) for r in relations]})


def test_settings_of_models(tmp_path):
    for bad in ({"relations": ()}, {"entity_types": {}}, {"entity_types": {"tool": "x"}}, {"prompt_style": "loud"}, {"passage_selection": "none"}):
        with pytest.raises(ValueError):
            replace(SETTINGS, **bad)
    good = config.Example("An awl serves sewing.", reply([("e1", "awl", "tool"), ("e2", "sewing", "craft")], [("e1", "serves", "e2", "awl serves sewing")]))
    assert replace(SETTINGS, examples=(good,)).examples == (good,)
    for x in (replace(good, source="An owl."), replace(good, response="{}"), replace(good, response=good.response.replace("serves\"", "hates\"")), replace(good, response=good.response.replace("awl serves", "serves"))):
        with pytest.raises(ValueError):
            replace(SETTINGS, examples=(x,))
    with pytest.raises(ValueError):
        replace(SETTINGS, examples=(good,), prompt_style="compact-v1")
    for bad in ({"dtype": "float16"}, {"revision": "main"}, {"cpu_threads": 33}, {"max_new_tokens": 0}):
        with pytest.raises(ValueError):
            replace(SETTINGS.model, **bad)
    path = tmp_path / "g.toml"
    path.write_text(f"[generation]\ncontext_tokens = 100\n[generation.model]\nmodel_id = 'a/b'\nrevision = '{'0' * 40}'\n[generation.retrieval]\nstrategy = 'bm25'\n")
    got = config.load(str(path), "generation")
    assert got.retrieval.strategy == "bm25" and got.retrieval.top_k == 5
    with pytest.raises(ValueError):
        config.load(str(path), "generation", {"context_tokens": 2048})
    path.write_text(f"[llm_extraction]\nentity_types = {{a = 'one'}}\n[llm_extraction.model]\nmodel_id = 'a/b'\nrevision = '{'0' * 40}'\n[[llm_extraction.relations]]\npredicate = 'p'\ndescription = 'd'\nsubject_types = ['a']\nobject_types = ['a']\n")
    assert config.load(str(path), "llm_extraction").relations[0].object_types == ("a",)


def test_selection_and_numbers():
    text = "  No cue here. The awl was used by Ann.\n\nIt introduces Bo!  She proposed a plan. It uses more."
    assert [text[a:b] for a, b in proposals.selected_ranges(text, "relation-cues-v1")] == ["The awl was used by Ann.", "It introduces Bo!"]
    assert proposals.selected_passage(text, "relation-cues-v2") == "The awl was used by Ann.\n\nIt introduces Bo!"
    assert proposals.selected_ranges("A modification of B.", "relation-cues-v1") == [] and proposals.selected_ranges("A modification of B.", "relation-cues-v2") == [(0, 20)]
    assert proposals.selected_ranges(text) == [(0, len(text))] and proposals.selected_ranges("", "relation-cues-v1") == []
    assert [text[a:b] for a, b in proposals.numbered_spans(text)][:2] == ["No cue here.", "The awl was used by Ann."]
    assert proposals.name_places("Elm Helm elm Elm_ Elm.", "Elm") == [(0, 3), (18, 21)] and proposals.name_places("a C++ b C++x", "C++") == [(2, 5), (8, 11)]


@pytest.mark.parametrize("entities, relations, issue", [
    ([("e1", "awl", "tool"), ("e2", "sewing", "craft")], [("e1", "serves", "e2", "awl serves sewing")], None),
    ([("e1", "awl", "tool"), ("e2", "sewing", "craft")], [("e2", "serves", "e1", "awl serves sewing")], "invalid_relation"),
    ([("e1", "awl", "tool"), ("e2", "sewing", "craft")], [("e1", "serves", "e3", "awl serves sewing")], "invalid_relation"),
    ([("e1", "awl", "tool"), ("e2", "sewing", "craft")], [("e1", "serves", "e2", "awl")], "invalid_quote"),
    ([("e1", "awl", "tool"), ("e2", "sewing", "craft")], [("e1", "serves", "e2", "An awl mends sewing")], "invalid_quote"),
    ([("e1", "awl", "tool"), ("e2", "aw", "craft")], [], "invalid_entity"),
    ([("e1", "awl", "bird")], [], "invalid_entity"),
    ([("e1", " awl", "tool")], [], "invalid_entity"),
    ([("e1", "awl", "tool"), ("e1", "sewing", "craft")], [], "invalid_json"),
    ([("e 1", "awl", "tool")], [], "invalid_json"),
])
def test_proposals_one_fault_each(entities, relations, issue):
    text = "An awl serves sewing. The awl is old. An awl."
    got = proposals.accept(text, reply(entities, relations), "stop", SETTINGS)
    assert [i for i, _ in got["issues"]] == ([issue] if issue else []) and got["rejected"] == (issue == "invalid_json")
    assert bool(got["relations"]) == (issue is None)
    if issue is None:
        assert [text[a:b] for *_, a, b in got["relations"]] == ["awl serves sewing"] and got["entities"][0][2] == proposals.name_places(text, "awl")


def test_proposals_forms():
    text = "An awl serves sewing. Ann sews."
    ok = reply([], [])
    for bad in ("", "[]", "{}", ok[:-1], ok.replace("[]", "[1]", 1), ok[:-1] + ',"more":1}', ok.replace('"relations"', '"entities"'), '{"entities":[],"relations":NaN}', "[" * 5000):
        assert proposals.accept(text, bad, "stop", SETTINGS)["rejected"]
    assert proposals.accept(text, ok, "length", SETTINGS)["issues"][0][0] == "output_limit"
    trimmed = proposals.accept(text, reply([("e1", " awl ", "tool")], []), "stop", replace(SETTINGS, strip_entity_whitespace=True))
    assert trimmed["issues"][0][0] == "normalized_entity" and trimmed["entities"] == [("tool", "awl", [(3, 6)])]
    one = replace(SETTINGS, prompt_style="indexed-v1")
    row = ["awl", "tool", "serves", "sewing", "craft", 1]
    named = dict(zip(("subject", "subject_type", "predicate", "object", "object_type", "sentence_id"), row))
    for r in (row, named):
        got = proposals.accept(text, json.dumps({"relations": [r]}), "stop", one)
        assert [text[a:b] for *_, a, b in got["relations"]] == ["An awl serves sewing."] and not got["issues"]
    for at, rejected in ((2, False), (3, False), (0, True), (True, True), ("1", True)):
        got = proposals.accept(text, json.dumps({"relations": [[*row[:5], at]]}), "stop", one)
        assert got["rejected"] == rejected and not got["relations"] and len(got["issues"]) == 1
    assert proposals.accept(text, json.dumps({"relations": [row] * 5}), "stop", one)["rejected"]


def test_model_extraction_and_replay(spark, tmp_path):
    docs = [(1, "An awl serves sewing. It is old."), (2, "A saw serves joinery."), (3, "Nothing."), (4, "Bad."), (5, "A saw serves joinery."), (6, "")]
    chunks = chunked(spark, docs).unionByName(spark.createDataFrame([("6.0", 6, 0, 0, "")], CHUNK))

    def provider(request):
        shown = json.loads(json.loads(request)["messages"][-1]["content"])["source_passage"]
        m = re.match(r"An? (\w+) serves (\w+)", shown)
        entities = [{"id": "e1", "name": m[1], "entity_type": "tool"}, {"id": "e2", "name": m[2], "entity_type": "craft"}] if m else []
        relations = [{"subject": "e1", "predicate": "serves", "object": "e2", "quote": m[0]}] if m else []
        return "no" if shown == "Bad." else json.dumps({"entities": entities, "relations": relations}), "stop"

    asked = proposals.requests(chunks, SETTINGS)
    assert {r["chunk_id"] for r in asked.where("origin = 'abstention'").collect()} == {"6.0"}
    made = proposals.complete(asked, provider)
    made.write.parquet(str(tmp_path / "receipts"))
    receipts = spark.read.parquet(str(tmp_path / "receipts"))
    assert receipts.count() == 4  # equal texts are asked about once
    out = proposals.process(chunks, receipts, SETTINGS)
    assert rows(out["entities"], "entity_type", "key") == [("craft", "joinery"), ("craft", "sewing"), ("tool", "awl"), ("tool", "saw")]
    assert rows(out["relations"], "document_id", "start", "end") == [(1, 0, 20), (2, 0, 20), (5, 0, 20)]
    assert rows(out["issues"], "chunk_id", "issue") == [("4.0", "invalid_json")] and rows(out["rejected"]) == [("4.0",)]
    assert out["evidence"].count() == 3 and out["mentions"].count() == 6
    again = proposals.complete(asked, lambda _: 1 / 0, receipts)
    assert rows(again) == rows(receipts) and proposals.receipt_faults(chunks, receipts, SETTINGS).count() == 0
    other = replace(SETTINGS, entity_types={**SETTINGS.entity_types, "tool": "another meaning"})
    changed = chunks.withColumn("text", F.concat("text", F.lit("!")))
    for c, s in ((chunks, other), (changed, SETTINGS)):
        assert {r["fault"] for r in proposals.receipt_faults(c, receipts, s).collect()} >= {"no receipt", "no request"}
        with pytest.raises(Exception, match="no receipt"):
            proposals.process(c, receipts, s)["relations"].collect()
    assert {r["fault"] for r in proposals.receipt_faults(chunks, receipts.unionAll(receipts), SETTINGS).collect()} == {"twice"}
    assert proposals.process(chunks, receipts.unionAll(receipts), SETTINGS)["relations"].count() == 3
    assert proposals.process(changed, receipts, SETTINGS, complete=False)["relations"].count() == 0
    assert proposals.fingerprint(other) != proposals.fingerprint(SETTINGS) == proposals.fingerprint(replace(SETTINGS))
    with pytest.raises(ValueError):
        proposals.check_spec(SETTINGS, {"model_id": "some/model", "revision": "b" * 40})
    fact = lambda s, o: {"subjects": [s, s.title()], "predicate": "serves", "objects": [o]}
    cases = spark.createDataFrame([("a", "1.0", [fact("awl", "sewing"), fact("awl", "weaving")]), ("b", "2.0", [fact("joinery", "saw")]), ("c", "3.0", []), ("d", "5.0", None)], "case_id string, chunk_id string, expected array<struct<subjects:array<string>,predicate:string,objects:array<string>>>")
    assert rows(proposals.score_sample(out["proposed"], cases)) == [("a", 2, 1, 1, 0), ("b", 1, 0, 1, 1), ("c", 0, 0, 0, 0), ("d", 0, 0, 1, 1)]
    packet = reviews.packet(cases, chunks)
    assert [(x["sentence_id"], x["text"]) for x in packet.where("case_id = 'a'").first()["sentences"]] == [(1, "An awl serves sewing."), (2, "It is old.")]
    assert reviews.packet_changed(packet, reviews.packet(cases, chunks)).count() == 0 < reviews.packet_changed(packet, reviews.packet(cases, changed)).count()


@pytest.mark.parametrize("style", config.PROMPT_STYLES)
def test_requests_show_the_passage_and_the_ontology(style):
    got = proposals.make_request("The quaint awl serves sewing.", replace(SETTINGS, prompt_style=style))
    body = json.dumps(got)
    assert "quaint" in got["messages"][-1]["content"] and "quaint" not in got["messages"][0]["content"] and all(x in body for x in ("serves", "craft", "is used for"))


def test_reviews(spark):
    ids = spark.createDataFrame([(i,) for i in range(8)], "q int")
    sheet = reviews.pending(ids.unionAll(ids), "q", reviews.CASE_CHECKS)
    assert sheet.count() == 8 and reviews.faults(sheet, ids, "q", notes_pending=False).count() == 0
    every = (True,) * 4
    day = __import__("datetime").date(2024, 5, 1)
    said = [
        (0, "pending", None, None, False, (None,) * 4, "a note"),
        (1, "pending", "x", None, False, (None,) * 4, None),
        (2, "approved", "x", day, True, every, "ok"),
        (3, "approved", "x", day, False, every, "ok"),
        (4, "approved", "x", day, True, (True, None, True, True), "ok"),
        (5, "revise", "x", None, False, (None,) * 4, "no"),
        (6, "maybe", None, None, False, (None,) * 4, None),
        (6, "revise", "x", day, False, (False,) * 4, "no"),
        (9, "revise", "x", day, False, (False,) * 4, "no"),
    ]
    table = spark.createDataFrame(said, sheet.schema)
    want = [(1, "pending but attested"), (3, "approved without every check"), (4, "approved without every check"), (5, "no reviewer, date or notes"), (6, "no decision"), (6, "reviewed twice"), (7, "not reviewed"), (9, "unknown")]
    assert rows(reviews.faults(table, ids, "q")) == want
    assert rows(reviews.faults(table, ids, "q", notes_pending=False)) == [(0, "pending but attested"), *want]
    assert reviews.decisions(table, held_out=True).first()[:] == (2, 3, 3, 9, False, False, 9)
    assert reviews.decisions(table.where("q = 2")).first()["all_approved"]


def test_graph_audit(spark):
    paths = spark.createDataFrame([(1, ["a", "b"], ["r1"]), (1, ["a"], []), (2, ["c"], [])], "query_id int, nodes array<string>, edges array<string>")
    links = spark.createDataFrame([(1, ["d", "a"])], "query_id int, candidates array<string>")
    got = reviews.graph_audit(paths, links, spark.createDataFrame([(x,) for x in "abcd"], "entity_id string"), spark.createDataFrame([("r1",), ("r2",)], "assertion_id string"))
    assert rows(got["assertions"], "query_id", "assertion_id") == [(1, "r1")] and rows(got["entities"], "query_id", "entity_id") == [(1, "a"), (1, "b"), (1, "d"), (2, "c")]


def test_gold_finds_passages_that_begin_or_end_inside_words(spark, tmp_path):
    words = ["sand", "and", "handy", "(and", "sandbar", "d", "x\ty", "über"]
    docs = [(i, " ".join(R.choices(words, k=12))) for i in range(20)] + [(20, None), (21, "")]
    spans = [(d, a, a + R.randrange(1, 30)) for d, a in ((R.randrange(20), R.randrange(30)) for _ in range(60))]
    asked = [(i, docs[d][1][a:b]) for i, (d, a, b) in enumerate(spans) if docs[d][1][a:b]] + [(90, ""), (91, None), (92, "nowhere at all here")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert any(len(p.split()) < 3 for _, p in asked if p) and any(len(p.split()) > 3 for _, p in asked if p)
    assert rows(inputs.gold(spark, str(tmp_path))) == sorted((q, d, t.find(p), t.find(p) + len(p)) for q, p in asked if p for d, t in docs if t and p in t)


def test_host_memory(tmp_path):
    path = tmp_path / "meminfo"
    path.write_text("MemTotal: 9 kB\nMemAvailable:    2097152 kB\n")
    assert host.memory_check(2.0, str(path)) == {"min_available_gib": 2.0, "available_bytes": 2 * host.GIB, "sufficient": True}
    assert host.require_memory(None, str(tmp_path / "none"))["sufficient"] is None
    for least, text in ((2.1, path.read_text()), (0.1, "MemAvailable: 5 MB\n"), (0.1, "")):
        path.write_text(text)
        with pytest.raises(MemoryError):
            host.require_memory(least, str(path))
    for bad in ("0", "-1", "nan", "inf", "much"):
        with pytest.raises(ValueError):
            host.positive_gib(bad)
    assert host.positive_gib("1.5") == 1.5
