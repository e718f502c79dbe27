"""Settings, ingestion, datasets, stores, runs and answers: against plain versions, and with things tampered with."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from evispan import config
from evispan.operators import chunking, generation, runs, stores
from evispan.sources import datasets, ingest

R = random.Random(3)


def test_settings(tmp_path):
    path = tmp_path / "s.toml"
    path.write_text("[benchmark]\ncutoffs = [1, 3]\nstrategies = ['bm25']\n[benchmark.graph]\nmax_hops = 1\n[benchmark.chunking]\nmax_units = 4\n")
    got = config.load(str(path), "benchmark", {"seed": 7, "repeats": None})
    assert got.cutoffs == (1, 3) and got.graph.max_hops == 1 and got.chunking.max_units == 4 and got.seed == 7 and got.repeats == 3
    assert config.load(None, "hybrid_retrieval").rank_constant == 60
    for table, values in [("graph_retrieval", {"max_hops": 3}), ("graph_retrieval", {"max_paths": 2}), ("hybrid_retrieval", {"vector_weight": 0, "graph_weight": 0}), ("benchmark", {"cutoffs": [3, 1]}), ("benchmark", {"nonsense": 1}), ("embedding", {"model_id": "x", "revision": "y"}), ("chunking", {"overlap_units": 9}), ("graph_retrieval", {"max_seeds": True})]:
        with pytest.raises(ValueError):
            config.load(None, table, values)
    with pytest.raises(ValueError):
        config.load(str(path), "chunking")


def test_rules(tmp_path):
    path = tmp_path / "r.toml"
    path.write_text("[[rules]]\nrule_id='a'\npattern='(?P<subject>\\w+) is a dye'\nsubject_type='dye'\ndeclares_subject=true\n[[rules]]\nrule_id='b'\npattern='(?P<subject>\\w+) tints (?P<object>\\w+)'\nobject_type='cloth'\npredicate='tints'\n")
    rules = config.load_rules(str(path))
    assert rules.fingerprint() == config.Rules(rules.rules[::-1]).fingerprint()
    for bad in ({"pattern": "("}, {"pattern": "x"}, {"pattern": "(?P<subject>x)"}, {"pattern": "(?P<subject>x)", "predicate": "p"}, {"pattern": "(?P<subject>x)(?P<alias>y)", "declares_subject": True}):
        with pytest.raises(ValueError):
            config.Rule("r", **bad)


def test_ingestion_round_trip_and_tampering(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    (src / "deep").mkdir(parents=True)
    (src / "a.md").write_text("﻿preface\n## Small\nOne. Two.\n# Big *title* #\nThree.\n\nFour.", encoding="utf-8")
    (src / "deep" / "b.TXT").write_text("# no heading here\nPlain words.")
    (src / "notes.pdf").write_bytes(b"%PDF")
    told = ingest.ingest_to_directory(spark, str(src), out)
    got = ingest.load(spark, out)
    docs = {r["relative_path"]: r for r in got["documents"].collect()}
    assert set(docs) == {"a.md", "deep/b.TXT"} and docs["a.md"]["title"] == "Big *title*" and docs["deep/b.TXT"]["title"] == "b" and docs["a.md"]["text"][0] == "p"
    assert docs["a.md"]["content_sha256"] == hashlib.sha256(docs["a.md"]["text"].encode()).hexdigest() != docs["a.md"]["raw_sha256"]
    assert [(r["text"], r["section"]) for r in got["chunks"].where(F.col("document_id") == docs["a.md"]["document_id"]).orderBy("ordinal").collect()] == [("preface", None), ("## Small\nOne. Two.", "Small"), ("# Big *title* #\nThree.", "Big *title*"), ("Four.", "Big *title*")]
    assert told["tables"]["documents"]["rows"] == 2
    bad = got["documents"].withColumn("sections", F.slice("sections", 2, 9))
    assert {r["fault"] for r in ingest.faults(bad, got["chunks"]).collect()} >= {"sections broken"}
    assert {r["fault"] for r in ingest.faults(got["documents"], got["chunks"].withColumn("start", F.col("start") + 1)).collect()} >= {"no slice"}
    assert ingest.faults(got["documents"], got["chunks"]).count() == 0
    with pytest.raises(ValueError, match="lies in"):
        ingest.ingest_to_directory(spark, str(src), str(src / "out"))
    with pytest.raises(Exception):
        ingest.ingest_to_directory(spark, str(src), out)
    (src / "c.md").write_bytes(b"\xff\xfe")
    (src / "d.txt").write_text(" \n")
    with pytest.raises(ValueError, match="c.md: not UTF-8; d.txt: blank"):
        ingest.ingest(spark, str(src))
    spark.read.parquet(f"{out}/chunks").limit(1).write.mode("append").parquet(f"{out}/chunks")
    with pytest.raises(ValueError, match="chunks"):
        ingest.load(spark, out)


def fixture(root):
    text = "Ochre tints linen. Ochre is old."
    span = lambda s: {"document_id": "d1", "start": text.index(s), "end": text.index(s) + len(s), "text": s, "chunk_id": "c1"}
    question = {"question_id": "q1", "question": "What tints linen?", "question_type": "factual", "expected_answer": "Ochre", "sufficient_evidence_sets": [{"facts": [{"fact_id": "f1", "statement": "it does", "spans": [span("Ochre tints linen.")]}]}], "relevant_document_ids": ["d1"], "relevant_entity_ids": ["e1"], "required_document_count": 1, "reasoning_hops": 1, "difficulty": "easy", "split": "dev", "group_id": "g1"}
    return {
        "corpus/documents.jsonl": [{"document_id": "d1", "title": "Dyes", "text": text, "content_sha256": hashlib.sha256(text.encode()).hexdigest(), "source_uri": "x:d1"}],
        "gold/chunks.jsonl": [{**span(text), "ordinal": 0}],
        "gold/entities.jsonl": [{"entity_id": "e1", "name": "Ochre", "entity_type": "dye", "aliases": [], "mentions": [span("Ochre")]}, {"entity_id": "e2", "name": "linen", "entity_type": "cloth", "aliases": [], "mentions": []}],
        "gold/relations.jsonl": [{"assertion_id": "a1", "subject_id": "e1", "predicate": "tints", "object_id": "e2", "evidence": [span("Ochre tints linen.")], "extraction_method": "m", "extraction_version": "1"}],
        "gold/questions.jsonl": [question],
        "ontology.json": {"entity_types": ["dye", "cloth"], "relation_types": ["tints"]},
    }


def put(root, data):
    files = {}
    for name, rows in data.items():
        body = json.dumps(rows) if name.endswith(".json") else "".join(json.dumps(r) + "\n" for r in rows)
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
        files[name] = hashlib.sha256(body.encode()).hexdigest()
    (root / "manifest.json").write_text(json.dumps({"fixture_id": "x", "files": files}))


def test_fixture_and_benchmark(spark, tmp_path):
    good = tmp_path / "good"
    put(good, fixture(good))
    t = datasets.load_fixture(spark, str(good))
    docs, own = datasets.load_benchmark(spark, f"{good}/corpus/documents.jsonl", f"{good}/gold/questions.jsonl", "dev")
    assert docs.count() == 1 and [r["question_id"] for r in own.collect()] == ["q1"]
    with pytest.raises(ValueError, match="no questions"):
        datasets.load_benchmark(spark, f"{good}/corpus/documents.jsonl", f"{good}/gold/questions.jsonl", "test")
    built = stores.Graph.build(t["entities"], t["relations"], t["documents"], t["chunks"])
    assert tuple(built.counts().first()) == (2, 1) and built.outgoing().first()["next"] == "e2" and [r["chunk_id"] for r in built.evidence().collect()] == ["c1"]
    (good / "ontology.json").write_text("{}")
    with pytest.raises(ValueError, match="ontology.json has changed"):
        datasets.load_fixture(spark, str(good))
    for n, (name, change, fault) in enumerate(
        [
            ("gold/entities.jsonl", lambda x: x[0].update(entity_type="fish"), "unknown type"),
            ("gold/relations.jsonl", lambda x: x[0].update(object_id="e9"), "end is no entity"),
            ("gold/questions.jsonl", lambda x: x.append({**x[0], "question_id": "q2", "split": "test"}), "group in several splits"),
            ("gold/questions.jsonl", lambda x: x[0].update(required_document_count=2), "labels"),
            ("gold/chunks.jsonl", lambda x: x[0].update(chunk_id="c9"), "no slice of a chunk"),
        ]
    ):
        bad, data = tmp_path / f"bad{n}", fixture(None)
        change(data[name])
        put(bad, data)
        with pytest.raises(ValueError, match=fault):
            datasets.load_fixture(spark, str(bad))
    (tmp_path / "l.jsonl").write_text('{"entity_id": "e"}\n\n{"entity_id": 1, \n')
    assert [(r["line"], r["issue"]) for r in datasets.line_faults(spark, str(tmp_path / "l.jsonl"), datasets.ENTITY).orderBy("line").collect()] == [(2, "blank line"), (3, "no record")]


def test_index_and_graph_belong_to_their_corpus(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.txt").write_text("Madder is red. Woad is blue.\n\nWeld is yellow.")
    told = ingest.ingest_to_directory(spark, str(src), str(tmp_path / "corpus"))
    got = ingest.load(spark, str(tmp_path / "corpus"))
    index = stores.build_index(got["chunks"], lambda texts: [[float(len(x)), 1.0] for x in texts], 1)
    stores.write_index(index, str(tmp_path / "index"), told, {"model": "m"})
    again = stores.load_index(spark, str(tmp_path / "index"), told, got["chunks"], {"model": "m"})
    assert again.count() == got["chunks"].count() and all(abs(sum(x * x for x in r["embedding"]) - 1) < 1e-9 for r in again.collect())
    for corpus, chunks, spec in ((told, got["chunks"], {"model": "n"}), ({"tables": {}}, got["chunks"], {"model": "m"}), (told, got["chunks"].limit(1), {"model": "m"})):
        with pytest.raises(ValueError):
            stores.load_index(spark, str(tmp_path / "index"), corpus, chunks, spec)
    with pytest.raises(Exception, match="zero or not finite"):
        stores.build_index(got["chunks"], lambda texts: [[0.0] for _ in texts]).collect()
    c = got["chunks"].orderBy("ordinal").first()
    entities = spark.createDataFrame([("e1", "Madder"), ("e2", "red")], "entity_id string, name string")
    span = (c["document_id"], c["start"], c["end"], c["text"], c["chunk_id"])
    relation = lambda s: spark.createDataFrame([("a1", "e1", "is", "e2", [s])], "assertion_id string, subject_id string, predicate string, object_id string, evidence array<struct<document_id:string,start:int,end:int,text:string,chunk_id:string>>")
    stores.Graph.build(entities, relation(span), got["documents"], got["chunks"]).write(str(tmp_path / "graph"), told)
    assert stores.load_graph(spark, str(tmp_path / "graph"), told, got["documents"], got["chunks"]).assertion("a1").count() == 1
    with pytest.raises(ValueError, match="no slice of a document: a1"):
        stores.Graph.build(entities, relation((*span[:3], "other", span[4])), got["documents"], got["chunks"])


def test_contexts_by_rendered_tokens():
    hits = [("c1", "d", 0, 10, "abcdefghij"), ("c2", "d", 5, 15, "fghijklmno"), ("c3", "d", 2, 9, "cdefghi"), ("c4", "e", 0, 90, "z" * 90), ("c5", "e", 0, 4, "zzzz")]
    got = runs.assemble(hits, 50, len)
    assert got["selected"] == ["c1", "c2", "c5"] and got["skipped_overlap"] == ["c3"] and got["skipped_budget"] == ["c4"]
    assert got["text"] == "[d:0:10]\nabcdefghij\n\n[d:10:15]\nklmno\n\n[e:0:4]\nzzzz" and got["token_count"] == len(got["text"])
    record = runs.Recorder(len)
    runs.assemble(hits, 50, record)
    assert runs.assemble(hits, 50, record.replay()) == got
    with pytest.raises(ValueError):
        runs.assemble(hits[1:], 50, record.replay())
    with pytest.raises(ValueError):
        runs.assemble(hits, 50, lambda s: 0)


def test_run_against_plain_version(spark):
    texts = {d: " ".join(R.choice(["plum", "fig", "pear", "kiwi"]) + R.choice(["", ".", "!"]) for _ in range(60)) for d in range(4)}
    rows = [(f"{d}-{n}", d, a, b, texts[d][a:b]) for d in texts for n, (a, b, _) in enumerate(chunking.chunk_text(texts[d], chunking.Chunking(60, 3, 1)))]
    by = {r[0]: r for r in rows}
    lists = {(q, s): R.sample(sorted(by), 6) for q in range(5) for s in ("bm25", "hybrid") if (q, s) != (4, "bm25")}
    gold = [(q, z, f"f{z}", z, 3 * q, 3 * q + 9) for q in range(5) for z in (0, 1)]
    hits = lambda s: spark.createDataFrame([(q, c, n + 1) for (q, own), cs in lists.items() if own == s for n, c in enumerate(cs)], "question_id int, chunk_id string, rank int")
    settings = config.Benchmark(strategies=("bm25", "hybrid"), cutoffs=(2, 5), max_context_tokens=14)
    got = runs.run_queries(spark.createDataFrame([(q,) for q in range(5)], "question_id int"), {s: hits(s) for s in ("bm25", "hybrid")}, spark.createDataFrame(rows, "chunk_id string, doc_id int, start int, end int, text string"), spark.createDataFrame(gold, "question_id int, set_id int, fact_id string, doc_id int, start int, end int"), settings)
    got = {(r["question_id"], r["strategy"], r["k"]): r for r in got.collect()}
    assert len(got) == 5 * 2 * 2

    def share(held, q):
        ok = [all(any(d == z and a <= p < b for d, a, b in held) for p in range(s, e)) for _, _, _, z, s, e in [g for g in gold if g[0] == q]]
        return float(any(ok)), any(ok)

    for (q, s, k), r in got.items():
        own = [by[c] for c in lists.get((q, s), [])[:k]]
        made = runs.assemble([(c, str(d), a, b, t) for c, d, a, b, t in own], 14)
        assert (r["raw_coverage"], r["raw_complete"]) == share([(d, a, b) for _, d, a, b, _ in own], q)
        assert (r["budgeted_coverage"], r["budgeted_complete"]) == share([(int(p[0]), p[1], p[2]) for p in made["pieces"]], q)
        assert (r["token_count"], r["n_selected"], r["n_skipped_budget"]) == (made["token_count"], len(made["selected"]), len(made["skipped_budget"]))
    assert runs.report(spark.createDataFrame(list(got.values()))).count() == 4


def test_graph_and_hybrid_search(spark):
    entities = spark.createDataFrame([("e1", "Madder"), ("e2", "Wool"), ("e3", "Red Oxide")], "entity_id string, name string").withColumn("aliases", F.array().cast("array<string>"))
    edges = spark.createDataFrame([("a1", "e1", "dyes", "e2"), ("a2", "e3", "dyes", "e2")], "edge_id string, src string, predicate string, dst string")
    evidence = spark.createDataFrame([("a1", "c1"), ("a2", "c2")], "edge_id string, chunk_id string")
    mentions = spark.createDataFrame([("e3", "c3")], "node string, chunk_id string")
    asked = spark.createDataFrame([(1, "does MADDER dye things?"), (2, "nothing known")], "query_id int, query string")
    got = runs.graph_search(asked, entities, edges, evidence, mentions, 5)
    assert [(r["query_id"], r["chunk_id"], r["rank"]) for r in got.orderBy("rank").collect()] == [(1, "c1", 1), (1, "c2", 2), (1, "c3", 3)]
    vector = spark.createDataFrame([(1, "c9", 1), (1, "c2", 2), (2, "c9", 1)], "query_id int, chunk_id string, rank int")
    fused = runs.hybrid(vector, got, 2, config.HybridRetrieval(graph_weight=0.5)).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["chunk_id"], r["candidates"]) for r in fused] == [(1, "c2", 4), (1, "c9", 4), (2, "c9", 1)]


PIECES = [("d1", 10, 30, "Weld gives a yellow.", "c1"), ("d2", 0, 9, "No no no.", "c2")]


def reply(*quotes, status="answered"):
    return json.dumps({"status": status, "claims": [{"text": "It *does*.", "citations": [{"source_id": s, "quote": q} for s, q in quotes]}] if quotes else []})


def test_answers_are_validated_whole():
    good = generation.validate(PIECES, reply(("S1", "yellow"), ("S2", "No no")))
    assert good["status"] == "answered" and [(c["doc_id"], c["start"], c["end"]) for c in good["claims"][0]["citations"]] == [("d1", 23, 29), ("d2", 0, 5)]
    for bad, issue in [(reply(("S3", "yellow")), "invalid_citation"), (reply(("S2", "no")), "invalid_citation"), (reply(("S1", "a"), ("S1", "a")), "invalid_citation"), (reply(), "invalid_response"), (reply(("S1", "a"), status="insufficient_evidence"), "invalid_response"), ('{"status": "answered", "status": "answered", "claims": []}', "invalid_response"), ("[1]", "invalid_response"), ('{"status": NaN, "claims": []}', "invalid_response")]:
        assert generation.validate(PIECES, bad)["issue"] == issue
    assert generation.validate(PIECES, reply(("S1", "yellow")), "length")["issue"] == "output_limit"
    assert generation.validate([], None)["status"] == "insufficient_evidence" == generation.validate(PIECES, reply(status="insufficient_evidence"))["status"]
    shown = generation.render_answer("Which [dye]?", good)
    assert "# Which \\[dye\\]?" in shown and "It \\*does\\*. [1][2]" in shown and '2. d2, 0 to 5: "No no"' in shown


def test_answers_replay_from_receipts(spark):
    kind = "array<struct<doc_id:string,start:int,end:int,text:string,chunk_id:string>>"
    shown = spark.createDataFrame([(1, "which?", PIECES), (2, "which?", PIECES), (3, "what?", [])], f"question_id int, query string, pieces {kind}")
    settings, text = {"model": "m", "max": 5}, reply(("S1", "yellow"))
    receipts = generation.generate(generation.requests(shown, settings), lambda r: text).collect()
    assert len(receipts) == 1
    receipts = spark.createDataFrame(receipts)
    got = {r["question_id"]: r for r in generation.replay(shown, receipts, settings).collect()}
    assert [got[i]["status"] for i in (1, 2, 3)] == ["answered", "answered", "insufficient_evidence"] and got[1]["claims"][0]["citations"][0]["quote"] == "yellow"
    never = lambda r: 1 / 0
    assert generation.generate(generation.requests(shown, settings), never, receipts).count() == 1
    with pytest.raises(Exception, match="no receipt"):
        generation.replay(shown, receipts, settings | {"max": 6}).collect()
    with pytest.raises(Exception, match="no receipt"):
        generation.replay(shown.withColumn("query", F.lit("changed")), receipts, settings).collect()
