import math
import random
import re

import pytest
from pyspark.sql import functions as F

from evispan.functions import text as t
from evispan.operators import answers, checks, chunking, context, extract, graph, intervals, search
from evispan.sources import files


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_bm25_by_hand(spark):
    chunks = spark.createDataFrame([("a", "lathe lathe quartz"), ("b", "quartz"), ("c", "")], "chunk_id string, text string")
    got = search.bm25(chunks, spark.createDataFrame([(1, "Lathe lathe"), (2, "mica")], "query_id int, query string")).collect()
    assert [(r["query_id"], r["chunk_id"], r["rank"]) for r in got] == [(1, "a", 1)]
    n, df, avg = 3, 1, 4 / 3
    assert math.isclose(got[0]["score"], math.log(1 + (n - df + 0.5) / (df + 0.5)) * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / avg)))


def test_tokens_and_names(spark):
    r = spark.createDataFrame([("MÜßIG; Ärger?",)], "s string").select(t.tokenize(F.col("s")), t.normalize_name(F.lit("  Ab \n C "))).first()
    assert r[0] == ["müssig", "ärger"] and r[1] == "ab c"


def test_cosine_ties_and_negatives(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert rows(search.cosine(v, q, 3).select("rank", "vec_id", "score")) == [(1, 1, 1.0), (2, 2, 1.0), (3, 3, -1.0)]


@pytest.mark.parametrize("constant", [0, 10, 60, 100])
def test_fusion_order(spark, constant):
    mk = lambda names: spark.createDataFrame([(1, n, i + 1) for i, n in enumerate(names)], "q int, chunk_id string, rank int")
    got = search.fuse(mk("abc"), mk("bda"), ["q"], constant=constant).orderBy("rank").collect()
    score = {c: sum(1 / (constant + x.index(c) + 1) for x in ("abc", "bda") if c in x) for c in "abcd"}
    assert [r["chunk_id"] for r in got] == sorted(score, key=lambda c: (-score[c], c))
    with pytest.raises(ValueError):
        search.fuse(mk("a"), mk("b"), ["q"], weights=(0, 0))


def test_merge_and_uncovered_against_sets(spark):
    r = random.Random(3)
    data = [(g, a, a + r.randint(1, 9)) for g in range(12) for a in [r.randint(0, 60) for _ in range(r.randint(1, 8))]]
    df = spark.createDataFrame(data, "g int, start int, end int")
    merged, gaps = intervals.merge(df, ["g"]), intervals.uncovered(df.select("g", F.lit(0).alias("start"), F.lit(75).alias("end")).distinct(), df, ["g"])
    for g in range(12):
        held = {i for x, a, b in data if x == g for i in range(a, b)}
        assert {i for x, a, b in rows(merged) if x == g for i in range(a, b)} == held
        assert {i for x, a, b in rows(gaps) if x == g for i in range(a, b)} == set(range(75)) - held


def test_covered_needs_one_stretch(spark):
    target = spark.createDataFrame([(1, 0, 4)], "g int, start int, end int")
    for parts, ok in (([(0, 2), (2, 4)], True), ([(0, 3), (1, 4)], True), ([(0, 1), (2, 4)], False), ([(0, 3)], False)):
        merged = intervals.merge(spark.createDataFrame([(1, a, b) for a, b in parts], "g int, start int, end int"), ["g"])
        assert intervals.covered(target, merged, ["g"]).first()["ok"] is ok


def test_context_overlap_and_budget(spark):
    hits = spark.createDataFrame([("q", 1, 7, 0, 6), ("q", 2, 7, 3, 9), ("q", 3, 7, 0, 9), ("q", 4, 8, 0, 50), ("q", 5, 8, 0, 3)], "q string, rank int, doc_id int, start int, end int")
    got = {r["rank"]: (r["status"], [tuple(p) for p in r["pieces"]]) for r in context.assemble(hits, ["q"], 20).collect()}
    assert got == {1: ("selected", [(0, 6)]), 2: ("selected", [(6, 9)]), 3: ("skipped_overlap", []), 4: ("skipped_budget", []), 5: ("selected", [(0, 3)])}


def test_evidence_alternatives_not_mixed(spark):
    spans = spark.createDataFrame([("q", 1, "a", 1, 0, 5), ("q", 1, "b", 1, 10, 15), ("q", 2, "a", 2, 0, 5), ("q", 2, "b", 2, 10, 15)], "question_id string, set_id int, fact_id string, doc_id int, start int, end int")
    sel = spark.createDataFrame([("q", 1, 0, 6), ("q", 2, 9, 20)], "question_id string, doc_id int, start int, end int")
    r = context.evidence(spans, sel).first()
    assert (r["coverage"], r["complete"]) == (0.5, False)


def test_walk_caps_and_cycle(spark):
    hub = spark.createDataFrame([(f"e{i}", "h", "p", f"n{i}") for i in range(5)], "edge_id string, src string, predicate string, dst string")
    seed = spark.createDataFrame([(1, "h")], "query_id int, node string")
    assert graph.walk(seed, hub, max_neighbors=2).count() == 3
    assert graph.walk(seed, hub, max_paths=2, max_seeds=1).count() == 2
    loop = spark.createDataFrame([("x", "A", "p", "B"), ("y", "B", "p", "A")], "edge_id string, src string, predicate string, dst string")
    assert graph.walk(spark.createDataFrame([(1, "A")], "query_id int, node string"), loop).count() == 3
    with pytest.raises(Exception, match="too many seeds"):
        graph.walk(spark.createDataFrame([(1, "a"), (1, "b")], "query_id int, node string"), loop, max_seeds=1).collect()


def chunked(text, *sizes):
    return [(text[a:b], label) for a, b, label in chunking.chunk_text(text, chunking.Chunking(*sizes))]


def test_chunk_windows():
    text = "alpha. bravo. carol. delta."
    assert chunked(text, 40, 2, 1) == [("alpha. bravo.", None), ("bravo. carol.", None), ("carol. delta.", None)]
    assert chunked(text, 13, 4, 3) == [("alpha. bravo.", None), ("bravo. carol.", None), ("carol. delta.", None)]
    assert chunked(text, 8, 4, 1) == [(x, None) for x in text.split()]
    with pytest.raises(ValueError):
        chunking.Chunking(10, 2, 2)


def test_paragraphs_end_windows_and_abbreviations_do_not():
    assert chunked("Red one.\nBlue two.\n \t\nGrey three.") == [("Red one.\nBlue two.", None), ("Grey three.", None)]
    assert [x for x, _ in chunked("Ask Prof. Q. R. Lind, Sec. 4 vs. No. 5! (So?) \"Ay.\" End", 800, 1, 0)] == ["Ask Prof. Q. R. Lind, Sec. 4 vs. No. 5!", "(So?)", '"Ay."', "End"]
    assert [x for x, _ in chunked("pebble " + "z" * 11 + " q", 6, 3, 0)] == ["pebble", "z" * 6, "z" * 5, "q"][:4]


def test_sections():
    lines = ["intro", "# Top ##", "a", "```x`y", "## In #no", "````", "# not", "~~~~", "```", "# hidden", "`````", "  ### ", "b", "#nothead", "    # code", "####### seven", "~~~ `", "# shut", "~~~", "# Last"]
    text = "\n".join(lines)
    got = [(text[a:b].splitlines()[0], label) for a, b, label in chunking.sections(text)]
    assert got == [("intro", None), ("# Top ##", "Top"), ("## In #no", "Top / In #no"), ("  ### ", "Top / In #no / Untitled section"), ("# Last", "Last")]
    assert chunking.sections("") == []


def plain_chunks(text, most, n, back):
    """The same windows by looking at every character and every size."""
    out = []
    for x, y, label in chunking.sections(text):
        for paragraph in re.split(r"\n[ \t]*\n", text[x:y]):
            spans, at = [], 0
            for piece in re.split(r"(?<=[.!?])\s+", paragraph.strip()):
                while len(piece) > most:
                    places = [i for i in range(1, most + 1) if piece[i].isspace() and not piece[i - 1].isspace()]
                    spans.append(piece[: places[-1] if places else most])
                    piece = piece[len(spans[-1]) :].strip()
                spans.append(piece)
            spans = [s for s in spans if s]
            for s in range(len(spans)):
                at = paragraph.index(spans[s], at)
                spans[s] = (at, at + len(spans[s]))
                at = spans[s][1]
            first = 0
            while first < len(spans):
                ok = [e for e in range(first + 1, len(spans) + 1) if e == first + 1 or (e - first <= n and spans[e - 1][1] - spans[first][0] <= most)]
                out.append((paragraph[spans[first][0] : spans[ok[-1] - 1][1]], label))
                if ok[-1] == len(spans):
                    break
                first = next(f for f in range(max(first + 1, ok[-1] - back), ok[-1] + 1) if f == ok[-1] or spans[ok[-1]][1] - spans[f][0] <= most)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_chunks_against_plain_version(seed):
    r = random.Random(seed)
    text = "".join(r.choice(["ab", "cde", "fghij" * 4, "kk.", "l!", "mn?"]) + r.choice([" ", " ", "  ", "\n", "\n\n", " \n \n"]) for _ in range(300))
    for most, n, back in ((7, 3, 1), (25, 4, 2), (60, 5, 0), (800, 5, 4)):
        assert chunked(text, most, n, back) == plain_chunks(text, most, n, back)


def test_segments_of_long_texts(spark):
    texts = ["ab. c! d?e f.", "", "a\u0001b. c", "x. " * 1000 + "end", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = t.sentences(df).collect()
    for i, body in enumerate(texts):
        own = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["ordinal"])
        assert "".join(r["text"] for r in own) == (body or "") and all(body[r["start"] : r["end"]] == r["text"] for r in own)
    assert len([r for r in got if r["doc_id"] == 3]) == 1001 and [r["text"] for r in got if r["doc_id"] == 2] == ["a\u0001b.", " c"]


def test_occurrences(spark):
    rows = [("aaaa", "aa", 3), ("x\\Ey\\Ey", "\\Ey", 2), ("a.b", "a.b", 1), ("acb", "a.b", 0), ("", "q", 0), ("ab", "", 0)]
    df = spark.createDataFrame(rows, "text string, quote string, n int").select("n", t.occurrences(F.col("text"), F.col("quote")).alias("got"))
    assert all(r["n"] == r["got"] for r in df.collect())


@pytest.mark.parametrize("most", [5, 12, 40, 800])
@pytest.mark.parametrize("overlap", [0, 1, 2])
def test_chunks_cover_and_progress(most, overlap):
    text = "# One\nFirst here. Second there, e.g. this! A\n\nword " + "x" * 30 + " end.\n```\n# no heading\n```\n## Two\nLast?"
    got = chunking.chunk_text(text, chunking.Chunking(most, 3, overlap))
    assert all(0 < b - a <= most for a, b, _ in got)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
    held = {i for a, b, _ in got for i in range(a, b)}
    assert all(c.isspace() for i, c in enumerate(text) if i not in held)
    assert {label for _, _, label in got} == {"One", "One / Two"}


def test_link_takes_longest(spark):
    e = extract.registry(spark.createDataFrame([("t", "Dale"), ("t", "Long Dale"), ("t", "Fuß")], "entity_type string, name string"))
    q = spark.createDataFrame([(1, "long dale, old-dale and DALE on FUSS")], "query_id int, query string")
    assert [r["surface"] for r in extract.link(q, e).orderBy("start").collect()] == ["long dale", "dale", "fuss"]


def test_rules_exactly_one(spark):
    rules = [{"rule_id": n, "pattern": p, "predicate": n, "subject_type": "x", "object_type": "x"} for n, p in (("a", r"(\w+) uses (\w+)"), ("b", r"(\w+) (?:uses|has) (\w+)"))]
    got = extract.match_rules(spark.createDataFrame([(1, "A uses B"), (2, "A has B"), (3, "none")], "i int, statement string"), rules)
    assert rows(got.select("i", "rule_id", "issue")) == [(1, None, "multiple_rules"), (2, "b", None), (3, None, "unmatched_statement")]


def test_answers(spark):
    for bad in ('{"a":1,"a":2}', '{"a":NaN}', "[1]", "x"):
        with pytest.raises(ValueError):
            answers.strict_json(bad)
    sources = spark.createDataFrame([(1, "S1", "aaa b"), (2, "S1", "unique")], "answer_id int, source_id string, text string")
    cites = spark.createDataFrame([(1, "S1", "aa"), (2, "S1", "uniq"), (3, "S1", "x")], "answer_id int, source_id string, quote string")
    assert rows(answers.validate_citations(cites, sources)) == [(1, 1, False), (2, 1, True), (3, 1, False)]


def test_checks(spark):
    docs = spark.createDataFrame([(1, "héllo")], "doc_id int, text string")
    spans = spark.createDataFrame([(1, 1, 3, "él"), (1, 0, 2, "xx"), (2, 0, 1, "h")], "doc_id int, start int, end int, text string")
    assert rows(checks.bad_spans(spans, docs).select("doc_id", "start")) == [(1, 0), (2, 0)]
    assert rows(checks.gaps_in_order(spark.createDataFrame([(1, 0), (1, 2)], "d int, ordinal int"), "d")) == [(1, 2)]


def test_files(spark, tmp_path):
    assert files.canonical_json({"b": "é", "a": 1}) == '{"a":1,"b":"é"}\n'.encode()
    with pytest.raises(ValueError):
        files.canonical_json({"a": float("nan")})
    out = f"{tmp_path}/run"
    files.write_once({"t": spark.range(5).toDF("x")}, out, {"k": 1})
    assert files.verify(spark, out) == []
    with pytest.raises(Exception):
        files.write_once({"t": spark.range(5).toDF("x")}, out)
    (tmp_path / "c.toml").write_text("[chunking]\nmax_chars = 9\n")
    assert files.load_settings(str(tmp_path / "c.toml"), "chunking", chunking.Chunking, max_units=2).max_chars == 9
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.md").write_text("# Title\nbody")
    assert files.read_texts(spark, str(tmp_path / "d")).first()["title"] == "Title"
