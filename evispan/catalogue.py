"""Registered queries of the engine and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from evispan.functions import text as t
from evispan import config as config_
from evispan.operators import answers, checks, chunking, context, extract, graph, intervals, proposals, reviews, runs, search, statements
from evispan.plans import inputs as i

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that must give the same rows."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


W = r"[\p{L}\p{N}_]+"
_FOLD = "replace(lower({}), 'ß', 'ss')"
_SENT = r"""sent AS (SELECT doc_id, ordinal, CAST(coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS s, text FROM (SELECT doc_id, unnest(range(len(p))) AS ordinal, unnest(p) AS text FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?]+)([ \t\n\r\f])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS p FROM documents))),
chunks AS (SELECT printf('%012d:%06d', doc_id, ordinal) AS chunk_id, doc_id, s AS c_start, CAST(s + length(text) AS INTEGER) AS c_end, text FROM sent WHERE trim(regexp_replace(text, '[\t\n\r\f]', ' ', 'g')) <> '')"""
_BM25 = rf"""{_SENT},
toks AS (SELECT chunk_id, regexp_extract_all({_FOLD.format('text')}, '{W}') AS ts FROM chunks),
st AS (SELECT count(*) AS n, avg(CAST(len(ts) AS DOUBLE)) AS av FROM toks),
tf AS (SELECT chunk_id, any_value(l) AS l, term, count(*) AS tf FROM (SELECT chunk_id, len(ts) AS l, unnest(ts) AS term FROM toks) GROUP BY chunk_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qt AS (SELECT DISTINCT item_id AS question_id, unnest(regexp_extract_all({_FOLD.format('text')}, '{W}')) AS term FROM benchmark),
sc AS (SELECT question_id, chunk_id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / av))) AS score FROM qt JOIN tf USING (term) JOIN df USING (term) CROSS JOIN st GROUP BY ALL),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM sc WHERE score > 0) WHERE rank <= 10)"""
_GOLD = "gold AS (SELECT item_id AS question_id, doc_id, CAST(instr(d.text, b.text) - 1 AS INTEGER) AS s, CAST(instr(d.text, b.text) - 1 + length(b.text) AS INTEGER) AS e FROM documents d JOIN benchmark b ON instr(d.text, b.text) > 0)"
_MERGED = "SELECT question_id, doc_id, island, min(c_start) AS a, max(c_end) AS b FROM (SELECT *, sum(CASE WHEN reach IS NULL OR c_start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY question_id, doc_id ORDER BY c_start, c_end ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT h.question_id, c.doc_id, c_start, c_end, max(c_end) OVER (PARTITION BY h.question_id, c.doc_id ORDER BY c_start, c_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM hits h JOIN chunks c USING (chunk_id))) GROUP BY ALL"
_EDGES = """edges AS (SELECT 'nr:' || n_nationkey AS edge_id, 'n' || n_nationkey AS src, 'in_region' AS predicate, 'r' || n_regionkey AS dst FROM nation UNION ALL SELECT 'sn:' || s_suppkey, 's' || s_suppkey, 'in_nation', 'n' || s_nationkey FROM supplier UNION ALL SELECT 'cn:' || c_custkey, 'c' || c_custkey, 'in_nation', 'n' || c_nationkey FROM customer UNION ALL SELECT 'oc:' || o_orderkey, 'o' || o_orderkey, 'placed_by', 'c' || o_custkey FROM orders UNION ALL SELECT 'ls:' || l_orderkey || ':' || l_linenumber, 'o' || l_orderkey, 'supplied_by', 's' || l_suppkey FROM lineitem)"""
_STATE = """st AS (SELECT c_custkey AS statement_id, CASE c_custkey % 3 WHEN 0 THEN c_name || ' buys as ' || c_mktsegment || '.' WHEN 1 THEN c_name || ' is in the ' || n_name || ' nation.' ELSE c_name || ' has an account' END AS statement FROM customer JOIN nation ON c_nationkey = n_nationkey),
m AS (SELECT *, CAST(regexp_full_match(statement, '(\\S+) is in the (.+) nation\\.') AS INT) AS m1, CAST(regexp_full_match(statement, '(\\S+) buys as (.+)\\.') AS INT) AS m2, CAST(regexp_full_match(statement, '(\\S+) is (.+)\\.') AS INT) AS m3 FROM st)""".replace("\\\\", "\\")
_SAID = "said AS (SELECT c_custkey AS statement_id, c_custkey % 3 AS kind, CASE c_custkey % 3 WHEN 0 THEN 'segment' WHEN 1 THEN 'in_nation' END AS predicate, CASE WHEN c_custkey % 3 < 2 THEN lower(c_name) END AS subject, CASE c_custkey % 3 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN lower(n_name) END AS object FROM customer JOIN nation ON c_nationkey = n_nationkey)"
_RUNS = "runs AS (SELECT event_type AS strategy, CASE WHEN event_id % 2 = 0 THEN 5 ELSE 10 END AS k, user_id % 40 AS question_id, 't' || (user_id % 3) AS qtype, CAST(user_id % 2 AS INTEGER) AS hops, CAST(user_id % 4 AS INTEGER) AS docs, event_id % 3 = 0 AS complete, (event_id % 5) / 4.0::DOUBLE AS coverage, value AS ms FROM events)"


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


# text and segments


@query(rf"SELECT doc_id, sha256(text) AS content_sha256, CAST(length(text) AS INTEGER) AS chars, len(regexp_extract_all({_FOLD.format('text')}, '{W}')) AS n_tokens FROM documents")
def tokenize_terms(spark, d):
    return i.documents(spark, d).select("doc_id", F.sha2("text", 256).alias("content_sha256"), F.length("text").alias("chars"), F.size(t.tokenize(F.col("text"))).cast("long").alias("n_tokens"))


@query(rf"SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(regexp_extract_all({_FOLD.format('text')}, '{W}')) AS term FROM documents) GROUP BY term")
def term_stats(spark, d):
    return search.postings(i.documents(spark, d), key="doc_id").groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


@query(r"SELECT p_partkey, trim(regexp_replace(replace(lower(p_name), 'ß', 'ss'), '\s+', ' ', 'g')) AS key FROM part")
def normalize_names(spark, d):
    return i.table(spark, d, "part").select("p_partkey", t.normalize_name(F.col("p_name")).alias("key"))


@query(f"WITH {_SENT} SELECT doc_id, ordinal AS ordinal, s AS start, CAST(s + length(text) AS INTEGER) AS \"end\", text FROM sent")
def sentence_segments(spark, d):
    return t.sentences(i.documents(spark, d)).withColumn("ordinal", F.col("ordinal").cast("long"))


@query("SELECT doc_id, o AS ordinal, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start, text FROM (SELECT doc_id, unnest(range(len(p))) AS o, unnest(p) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))")
def lines_split(spark, d):
    return t.lines(i.documents(spark, d)).select("doc_id", F.col("ordinal").cast("long"), "start", "text")


@query(rf"WITH {_SENT} SELECT doc_id, ordinal, s AS start, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS r FROM sent WHERE regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}_])(is|est|ist|es)($|[^\p{{L}}\p{{N}}_])')) WHERE r <= 2")
def cue_sentences(spark, d):
    w = Window.partitionBy("doc_id").orderBy("ordinal")
    return t.sentences(i.documents(spark, d)).where(F.lower("text").rlike(r"(^|[^\p{L}\p{N}_])(is|est|ist|es)($|[^\p{L}\p{N}_])")).withColumn("r", F.row_number().over(w)).where("r <= 2").select("doc_id", F.col("ordinal").cast("long"), "start", "text")


@query()
def chunk_windows(spark, d):
    return chunking.chunk(i.documents(spark, d))


# constraints


@query("SELECT text_sha, count(*) AS n FROM (SELECT sha256(text) AS text_sha FROM documents) GROUP BY 1 HAVING count(*) > 1")
def validate_unique(spark, d):
    return checks.duplicates(i.documents(spark, d).select(F.sha2("text", 256).alias("text_sha")), "text_sha")


@query(f"WITH {_SENT} SELECT doc_id, ordinal AS start FROM sent WHERE false")
def validate_spans(spark, d):
    return checks.bad_spans(t.sentences(i.documents(spark, d)), i.documents(spark, d)).select("doc_id", F.col("ordinal").cast("long").alias("start"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0)")
def validate_references(spark, d):
    return checks.orphans(i.table(spark, d, "orders"), "o_custkey", i.table(spark, d, "customer").where("c_custkey % 7 <> 0"), "c_custkey").select("o_orderkey")


@query("SELECT c_mktsegment, count(DISTINCT c_nationkey) AS n FROM customer GROUP BY 1 HAVING count(DISTINCT c_nationkey) > 1")
def validate_splits(spark, d):
    return checks.spanning(i.table(spark, d, "customer"), "c_mktsegment", "c_nationkey")


@query("SELECT doc_id, 'first' AS side FROM documents WHERE doc_id % 10 = 0 UNION ALL SELECT -doc_id - 1, 'second' FROM documents WHERE doc_id % 10 = 0")
def exceptall_replay(spark, d):
    a = i.documents(spark, d).select("doc_id")
    return checks.difference(a, a.select(F.when(F.col("doc_id") % 10 == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("doc_id")))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS norm FROM embeddings")
def vector_norm_check(spark, d):
    e = i.table(spark, d, "embeddings")
    return e.select("vec_id", F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x)), 6).alias("norm"))


# rankings


@query(f"WITH {_BM25} SELECT question_id, chunk_id, round(score, 6) AS score, rank FROM hits")
def bm25_topk(spark, d):
    return _rounded(i.bm25_hits(spark, d), "score").select("question_id", "chunk_id", "score", F.col("rank").cast("long"))


_COS = "list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda z: CAST(z[1] AS DOUBLE) * z[2])) / (sqrt(list_sum(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform(v.embedding, lambda x: CAST(x AS DOUBLE) * x))))"
_VHITS = f"vh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id, round({_COS}, 9) AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0)) WHERE rank <= 20)"


@query(f"WITH {_VHITS} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM vh WHERE rank <= 10")
def vector_topk(spark, d):
    hits = search.cosine(i.table(spark, d, "embeddings"), i.vector_queries(spark, d), 10)
    return _rounded(hits, "score").select("query_id", "vec_id", "score", F.col("rank").cast("long"))


def _two(spark, d):
    hits = search.cosine(i.table(spark, d, "embeddings"), i.vector_queries(spark, d), 20).select("query_id", F.col("vec_id").alias("chunk_id"), "rank")
    e = i.table(spark, d, "embeddings")
    q = i.vector_queries(spark, d).join(e.select(F.col("vec_id").alias("query_id"), "label"), "query_id").select("query_id", "label")
    same = q.join(e.select("vec_id", "label"), "label").select("query_id", F.col("vec_id").alias("chunk_id"), F.lit(1.0).alias("score"))
    return hits, search.top_k(same, ["query_id"], 20).select("query_id", "chunk_id", "rank")


_LAB = "lh AS (SELECT * FROM (SELECT q.vec_id AS query_id, v.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY v.vec_id) AS rank FROM embeddings q JOIN embeddings v ON q.label = v.label AND q.vec_id % 100 = 0) WHERE rank <= 20)"
_RRF = "SELECT query_id, chunk_id, first_rank, second_rank, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.vec_id, b.vec_id) AS chunk_id, a.rank AS first_rank, b.rank AS second_rank, coalesce({w1}::DOUBLE / (60 + a.rank), 0) + coalesce({w2}::DOUBLE / (60 + b.rank), 0) AS score FROM vh a FULL JOIN lh b ON a.query_id = b.query_id AND a.vec_id = b.vec_id) WHERE score > 0"


def _fused(spark, d, weights):
    out = search.fuse(*_two(spark, d), by=["query_id"], weights=weights)
    return out.select("query_id", "chunk_id", *[F.col(c).cast("long") for c in ("first_rank", "second_rank")], F.round("score", 9).alias("score"), F.col("rank").cast("long"))


@query(f"WITH {_VHITS}, {_LAB} " + _RRF.format(w1="1.0", w2="1.0"))
def rrf_fusion(spark, d):
    return _fused(spark, d, (1.0, 1.0))


@query(f"WITH {_VHITS}, {_LAB} " + _RRF.format(w1="1.0", w2="0.25"))
def rrf_weighted(spark, d):
    return _fused(spark, d, (1.0, 0.25))


@query(f"WITH {_VHITS}, {_LAB} SELECT * FROM ({_RRF.format(w1='1.0', w2='0.5')}) WHERE rank <= 5")
def hybrid_topk(spark, d):
    return _fused(spark, d, (1.0, 0.5)).where("rank <= 5")


@query(f"WITH {_VHITS} SELECT query_id, min(rank) FILTER (hit) AS first_rank, CASE WHEN bool_and(hit) THEN max(rank) END AS group_rank FROM (SELECT w.query_id, w.vec_id, vh.rank, vh.rank IS NOT NULL AS hit FROM (SELECT q.vec_id AS query_id, v.vec_id FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0 AND v.vec_id IN (q.vec_id, q.vec_id + 1)) w LEFT JOIN vh USING (query_id, vec_id)) GROUP BY 1")
def group_rank(spark, d):
    hits = search.cosine(i.table(spark, d, "embeddings"), i.vector_queries(spark, d), 20)
    wanted = i.vector_queries(spark, d).select("query_id", F.explode(F.array("query_id", F.col("query_id") + 1)).alias("vec_id"))
    return search.shallowest(hits, wanted, ["query_id"], "vec_id").select("query_id", F.col("first_rank").cast("long"), F.col("group_rank").cast("long"))


# The queries above ask with every vector whose id is divisible by 100; those below ask with every vector. SQL would take rows times rows, so they have none.


def _all_hits(spark, d, k):
    return search.cosine_blocked(i.table(spark, d, "embeddings"), i.vectors_as_queries(spark, d), k)


@query()
def vector_topk_all(spark, d):
    return _rounded(_all_hits(spark, d, 10), "score").select("query_id", "vec_id", "score", F.col("rank").cast("long"))


def _fused_all(spark, d, weights):
    hits = _all_hits(spark, d, 20).select("query_id", F.col("vec_id").alias("chunk_id"), "rank")
    e = i.table(spark, d, "embeddings")
    # all of a label score alike, so its 20 smallest ids are the list of each of its vectors
    same = search.top_k(e.where("label IS NOT NULL").select("label", F.col("vec_id").alias("chunk_id"), F.lit(1.0).alias("score")), ["label"], 20)
    same = e.select(F.col("vec_id").alias("query_id"), "label").join(same, "label").select("query_id", "chunk_id", "rank")
    out = search.fuse(hits, same, by=["query_id"], weights=weights)
    return out.select("query_id", "chunk_id", *[F.col(c).cast("long") for c in ("first_rank", "second_rank")], F.round("score", 9).alias("score"), F.col("rank").cast("long"))


@query()
def rrf_fusion_all(spark, d):
    return _fused_all(spark, d, (1.0, 1.0))


@query()
def rrf_weighted_all(spark, d):
    return _fused_all(spark, d, (1.0, 0.25))


@query()
def hybrid_topk_all(spark, d):
    return _fused_all(spark, d, (1.0, 0.5)).where("rank <= 5")


@query()
def group_rank_all(spark, d):
    have = i.table(spark, d, "embeddings").select("vec_id")
    wanted = have.select(F.col("vec_id").alias("query_id"), F.explode(F.array("vec_id", F.col("vec_id") + 1)).alias("vec_id")).join(have, "vec_id", "left_semi")
    out = search.shallowest(_all_hits(spark, d, 20), wanted, ["query_id"], "vec_id")
    return out.select("query_id", F.col("first_rank").cast("long"), F.col("group_rank").cast("long"))


# intervals, context, evidence


def _c(spark, d):
    return i.chunks(spark, d).select("chunk_id", "doc_id", F.col("start").alias("c_start"), F.col("end").alias("c_end"))


@query(f"WITH {_SENT}, {_GOLD} SELECT question_id, doc_id, chunk_id FROM gold JOIN chunks USING (doc_id) WHERE c_start <= s AND e <= c_end")
def evidence_containment(spark, d):
    return intervals.containing(i.gold(spark, d), _c(spark, d)).select("question_id", "doc_id", "chunk_id")


@query(f"WITH {_SENT}, {_GOLD} SELECT question_id, doc_id, count(*) AS n FROM gold JOIN chunks USING (doc_id) WHERE c_start < e AND s < c_end GROUP BY ALL")
def interval_overlap(spark, d):
    return intervals.overlapping(i.gold(spark, d), _c(spark, d)).groupBy("question_id", "doc_id").agg(F.count("*").alias("n"))


@query(f"WITH {_BM25} SELECT question_id, doc_id, a AS start, b AS \"end\" FROM ({_MERGED})")
def interval_merge(spark, d):
    hits = i.bm25_hits(spark, d).select("question_id", "chunk_id").join(i.chunks(spark, d).select("chunk_id", "doc_id", "start", "end"), "chunk_id")
    return intervals.merge(hits.select("question_id", "doc_id", "start", "end"), ["question_id", "doc_id"])


@query("SELECT l_orderkey AS g, CAST(coalesce(lag(e) OVER w, 0) AS BIGINT) AS start, s AS \"end\" FROM (SELECT DISTINCT l_orderkey, CAST(l_linenumber * 10 AS BIGINT) AS s, CAST(l_linenumber * 10 + 5 AS BIGINT) AS e FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY s) UNION ALL SELECT l_orderkey, max(l_linenumber) * 10 + 5, 100 FROM lineitem GROUP BY 1")
def interval_uncovered(spark, d):
    cut = i.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("g"), (F.col("l_linenumber") * 10).cast("long").alias("start"), (F.col("l_linenumber") * 10 + 5).cast("long").alias("end"))
    whole = cut.select("g", F.lit(0).cast("long").alias("start"), F.lit(100).cast("long").alias("end")).distinct()
    return intervals.uncovered(whole, cut, ["g"])


@query("""WITH RECURSIVE x AS (SELECT l_orderkey AS g, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS rank, CAST(l_quantity AS BIGINT) AS cost FROM lineitem),
f AS (SELECT g, rank, cost, cost <= 100 AS admitted, CASE WHEN cost <= 100 THEN cost ELSE 0 END AS used FROM x WHERE rank = 1 UNION ALL SELECT x.g, x.rank, x.cost, f.used + x.cost <= 100, CASE WHEN f.used + x.cost <= 100 THEN f.used + x.cost ELSE f.used END FROM f JOIN x ON x.g = f.g AND x.rank = f.rank + 1)
SELECT g, rank, cost, admitted, used FROM f""")
def greedy_context(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    hits = i.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("g"), F.row_number().over(w).alias("rank"), F.col("l_quantity").cast("long").alias("cost"))
    return context.greedy(hits, 100, ["g"])


@query()
def assembled_context(spark, d):
    hits = i.bm25_hits(spark, d).join(i.chunks(spark, d).select("chunk_id", "doc_id", "start", "end"), "chunk_id")
    return context.assemble(hits, ["question_id"], 2000).select("question_id", "rank", "doc_id", "status")


def _run(spark, d):
    """Two strategies over all questions: BM25, and its fusion with a ranking that takes no heed of a chunk's length."""
    chunks, asked = i.chunks(spark, d), i.questions(spark, d)
    ranked = lambda b, k: search.bm25(chunks, asked, k, b=b, query="question_id").select("question_id", "chunk_id", "rank")
    config = config_.Benchmark(strategies=("bm25", "hybrid"), max_context_tokens=120)
    both = runs.hybrid(ranked(0.75, 20), ranked(0.0, 20), 10, config.hybrid, "question_id").select("question_id", "chunk_id", "rank")
    spans = i.gold(spark, d).select("question_id", F.col("doc_id").alias("set_id"), F.lit("f").alias("fact_id"), "doc_id", "start", "end")
    return runs.run_queries(asked, {"bm25": ranked(0.75, 10), "hybrid": both}, chunks, spans, config)


@query()
def run_queries(spark, d):
    return _run(spark, d)


@query()
def run_report(spark, d):
    return _rounded(runs.report(_run(spark, d)), "raw_coverage", "raw_complete", "budgeted_coverage", "budgeted_complete", "token_count", "n_skipped_overlap", "n_skipped_budget")


def _evidence(spark, d):
    hits = i.bm25_hits(spark, d).select("question_id", "chunk_id").join(i.chunks(spark, d).select("chunk_id", "doc_id", "start", "end"), "chunk_id")
    spans = i.gold(spark, d).select("question_id", F.col("doc_id").alias("set_id"), F.lit("f").alias("fact_id"), "doc_id", "start", "end")
    return context.evidence(spans, hits.select("question_id", "doc_id", "start", "end"))


_SCORE = f"score AS (SELECT question_id, max(CASE WHEN ok THEN 1.0::DOUBLE ELSE 0 END) AS coverage, bool_or(ok) AS complete FROM (SELECT g.question_id, g.doc_id, coalesce(bool_or(m.a <= g.s AND g.e <= m.b), false) AS ok FROM gold g LEFT JOIN ({_MERGED}) m ON m.question_id = g.question_id AND m.doc_id = g.doc_id GROUP BY 1, 2) GROUP BY 1)"


@query(f"WITH {_BM25}, {_GOLD}, {_SCORE} SELECT question_id, coverage, complete FROM score")
def evidence_score(spark, d):
    return _evidence(spark, d)


@query(f"WITH {_BM25}, {_GOLD}, {_SCORE} SELECT count(*) AS questions, count(*) FILTER (complete) AS n_complete, round(avg(CASE WHEN complete THEN 1.0::DOUBLE ELSE 0 END), 6) AS rate FROM score")
def complete_evidence_rate(spark, d):
    return _evidence(spark, d).agg(F.count("*").alias("questions"), F.count_if("complete").alias("n_complete"), F.round(F.avg(F.col("complete").cast("double")), 6).alias("rate"))


@query(f"WITH {_GOLD} SELECT item_id AS question_id FROM benchmark WHERE item_id NOT IN (SELECT question_id FROM gold)")
def unreachable_questions(spark, d):
    return i.questions(spark, d).join(i.gold(spark, d), "question_id", "left_anti").select("question_id")


@query(f"WITH {_SENT}, {_GOLD} SELECT question_id AS fact_id, chunk_id FROM gold JOIN chunks USING (doc_id) WHERE c_start <= s AND e <= c_end GROUP BY question_id, chunk_id HAVING count(DISTINCT doc_id) = (SELECT count(DISTINCT doc_id) FROM gold g WHERE g.question_id = gold.question_id)")
def single_chunk_division(spark, d):
    spans = i.gold(spark, d).select(F.col("question_id").alias("fact_id"), F.col("doc_id").alias("span_id"), "doc_id", "start", "end")
    return intervals.single_chunks(spans, _c(spark, d))


@query(f"WITH {_SENT}, {_GOLD} SELECT question_id, doc_id, CASE WHEN min(c_start) <= any_value(s) AND max(c_end) >= any_value(e) AND sum(least(c_end, e) - greatest(c_start, s)) = any_value(e) - any_value(s) THEN count(*) END AS n_chunks FROM gold JOIN chunks USING (doc_id) WHERE c_start < e AND s < c_end GROUP BY ALL")
def covering_run(spark, d):
    return intervals.covering_run(i.gold(spark, d), _c(spark, d)).select("question_id", "doc_id", "n_chunks")


# graph


@query(f"WITH {_EDGES} SELECT node, sum(o) AS out_degree, sum(i) AS in_degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY 1".replace("sum(o)", "CAST(sum(o) AS BIGINT)").replace("sum(i)", "CAST(sum(i) AS BIGINT)"))
def graph_degree(spark, d):
    return graph.degrees(i.edges(spark, d))


@query(f"WITH {_EDGES} SELECT src AS node, edge_id, dst AS next FROM edges WHERE predicate = 'in_nation'")
def graph_outgoing(spark, d):
    return graph.adjacency(i.edges(spark, d), "outgoing", ("in_nation",))


@query(f"WITH {_EDGES} SELECT dst AS node, edge_id, src AS next FROM edges WHERE predicate = 'placed_by'")
def graph_incoming(spark, d):
    return graph.adjacency(i.edges(spark, d), "incoming", ("placed_by",))


def _seeds(spark, d):
    return i.table(spark, d, "customer").where("c_custkey % 100 = 0").select(F.col("c_custkey").alias("query_id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"))


def _walk(spark, d, hops):
    return _path_rows(graph.walk(_seeds(spark, d), i.edges(spark, d), max_hops=hops, max_paths=40))


def _path_rows(p):
    return p.select("query_id", "hops", F.col("admitted").cast("long"), F.array_join("nodes", ">").alias("path"), F.array_join("edges", ">").alias("via"))


_ADJ = f"{_EDGES}, adj AS (SELECT src AS node, edge_id, dst AS next FROM edges UNION SELECT dst, edge_id, src FROM edges), p0 AS (SELECT c_custkey AS query_id, 'c' || c_custkey AS n0 FROM customer WHERE c_custkey % 100 = 0), p1 AS (SELECT * FROM (SELECT query_id, n0, next AS n1, edge_id AS e1, 1 + row_number() OVER (PARTITION BY query_id ORDER BY nr, er) AS admitted FROM (SELECT query_id, n0, next, edge_id, dense_rank() OVER (PARTITION BY query_id ORDER BY next) AS nr, row_number() OVER (PARTITION BY query_id, next ORDER BY edge_id) AS er FROM p0 JOIN adj ON adj.node = n0 AND next <> n0) WHERE nr <= 16 AND er <= 4) WHERE admitted <= 40)"
_L01 = "SELECT query_id, CAST(0 AS INTEGER) AS hops, CAST(1 AS BIGINT) AS admitted, n0 AS path, '' AS via FROM p0 UNION ALL SELECT query_id, 1, admitted, n0 || '>' || n1, e1 FROM p1"


@query(f"WITH {_ADJ} {_L01}")
def graph_walk_1hop(spark, d):
    return _walk(spark, d, 1)


@query(f"WITH {_ADJ}, p2 AS (SELECT * FROM (SELECT query_id, n0, n1, e1, next AS n2, edge_id AS e2, t + row_number() OVER (PARTITION BY query_id ORDER BY admitted, nr, er) AS place FROM (SELECT p1.*, next, edge_id, dense_rank() OVER (PARTITION BY query_id, admitted ORDER BY next) AS nr, row_number() OVER (PARTITION BY query_id, admitted, next ORDER BY edge_id) AS er FROM p1 JOIN adj ON adj.node = n1 AND next <> n1 AND next <> n0) JOIN (SELECT query_id, max(admitted) AS t FROM p1 GROUP BY 1) USING (query_id) WHERE nr <= 16 AND er <= 4) WHERE place <= 40) {_L01} UNION ALL SELECT query_id, 2, place, n0 || '>' || n1 || '>' || n2, e1 || '>' || e2 FROM p2")
def graph_walk_2hop_bounded(spark, d):
    return _walk(spark, d, 2)


@query(f"WITH {_ADJ}, f AS (SELECT query_id, n0, 0 AS hops, 'm:' || n0 AS chunk_id FROM p0 UNION ALL SELECT query_id, n0, 1, 'e:' || e1 FROM p1 UNION ALL SELECT query_id, n0, 1, 'm:' || n1 FROM p1), r AS (SELECT query_id, chunk_id, count(DISTINCT n0) AS groups, min(hops) AS min_hops FROM f GROUP BY 1, 2) SELECT query_id, chunk_id, groups, min_hops, rank, CAST(n - rank + 1 AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY groups DESC, min_hops, chunk_id) AS rank, count(*) OVER (PARTITION BY query_id) AS n FROM r) WHERE rank <= 10")
def graph_rank_chunks(spark, d):
    e = i.edges(spark, d)
    return _reached(e, graph.walk(_seeds(spark, d), e, max_hops=1, max_paths=40))


def _reached(e, paths):
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    out = graph.rank_evidence(paths, e.select("edge_id", F.concat(F.lit("e:"), "edge_id").alias("chunk_id")), nodes.select("node", F.concat(F.lit("m:"), "node").alias("chunk_id")))
    return out.select("query_id", "chunk_id", "groups", "min_hops", F.col("rank").cast("long"), "score")


# The walks above start from the 20 customers and end at the 40 paths their SQL names; those below start from every customer, with the engine's own cap.


def _all_seeds(spark, d):
    return i.table(spark, d, "customer").select(F.col("c_custkey").alias("query_id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"))


@query()
def graph_walk_1hop_all(spark, d):
    return _path_rows(graph.walk(_all_seeds(spark, d), i.edges(spark, d), max_hops=1))


@query()
def graph_walk_2hop_all(spark, d):
    return _path_rows(graph.walk(_all_seeds(spark, d), i.edges(spark, d), max_hops=2))


@query()
def graph_rank_chunks_all(spark, d):
    e = i.edges(spark, d)
    return _reached(e, graph.walk(_all_seeds(spark, d), e, max_hops=1))


@query("SELECT 'sn:' || s_suppkey AS path_id, s_suppkey % 2 = 0 AS valid FROM supplier")
def path_validate(spark, d):
    s, n = F.concat(F.lit("s"), F.col("s_suppkey").cast("string")), F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))
    nodes = F.when(F.col("s_suppkey") % 2 == 0, F.array(s, n)).otherwise(F.array(n, s))
    key = F.concat(F.lit("sn:"), F.col("s_suppkey").cast("string"))
    paths = i.table(spark, d, "supplier").select(key.alias("path_id"), nodes.alias("nodes"), F.array(key).alias("edges"))
    return graph.valid_paths(paths, i.edges(spark, d).where("predicate = 'in_nation'"))


# extraction and linking


@query(f"WITH {_STATE} SELECT statement_id, CASE WHEN m1 + m2 + m3 = 0 THEN 'unmatched_statement' WHEN m1 + m2 + m3 > 1 THEN 'multiple_rules' END AS issue, CASE WHEN m1 + m2 + m3 = 1 THEN CASE WHEN m1 = 1 THEN 'r1' WHEN m2 = 1 THEN 'r2' ELSE 'r3' END END AS rule_id FROM m")
def rule_match_exactly_one(spark, d):
    return extract.match_rules(i.statements(spark, d), i.RULES).select("statement_id", "issue", "rule_id")


@query(f"WITH {_STATE} SELECT coalesce(issue, 'matched') AS issue, count(*) AS n FROM (SELECT CASE WHEN m1 + m2 + m3 = 0 THEN 'unmatched_statement' WHEN m1 + m2 + m3 > 1 THEN 'multiple_rules' END AS issue FROM m) GROUP BY 1")
def rule_issues(spark, d):
    return extract.match_rules(i.statements(spark, d), i.RULES).groupBy(F.coalesce("issue", F.lit("matched")).alias("issue")).agg(F.count("*").alias("n"))


def _entities(spark, d):
    c = i.table(spark, d, "customer")
    return extract.registry(c.select(F.lit("customer").alias("entity_type"), F.col("c_name").alias("name")).unionAll(c.select(F.lit("segment"), "c_mktsegment").where("c_mktsegment <> 'BUILDING'")))


@query("SELECT statement_id, CASE WHEN seg = 'BUILDING' THEN 'unknown_entity' END AS issue, lower(c_name) AS subject_key, lower(seg) AS object_key FROM (SELECT c_custkey AS statement_id, c_name, c_mktsegment AS seg FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 = 0)")
def relations(spark, d):
    m = extract.match_rules(i.statements(spark, d), i.RULES[:2]).where("rule_id = 'r2'")
    return extract.relations(m, _entities(spark, d)).select("statement_id", "issue", "subject_key", "object_key")


@query("SELECT key, min(p_name) AS name, count(*) AS declared FROM (SELECT p_name, trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')) AS key FROM part) GROUP BY 1")
def entity_registry(spark, d):
    return extract.registry(i.table(spark, d, "part").select(F.lit("part").alias("entity_type"), F.col("p_name").alias("name"))).select("key", "name", "declared")


@query("SELECT trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')) AS surface, count(DISTINCT p_partkey) AS n_entities FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) > 1")
def alias_lookup(spark, d):
    return extract.ambiguity(i.table(spark, d, "part"), "p_name", "p_partkey")


@query("SELECT c_custkey AS doc_id, CAST(0 AS INTEGER) AS start, lower(c_name) AS surface FROM customer UNION ALL SELECT c_custkey, CAST(length(c_name) + 11 AS INTEGER), lower(n_name) FROM customer JOIN nation ON c_nationkey = n_nationkey")
def mentions(spark, d):
    c = i.table(spark, d, "customer").join(F.broadcast(i.table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    names = c.select(F.lit("customer").alias("entity_type"), F.col("c_name").alias("name")).unionAll(i.table(spark, d, "nation").select(F.lit("nation"), "n_name"))
    said = c.select(F.col("c_custkey").alias("doc_id"), F.concat("c_name", F.lit(" is in the "), "n_name", F.lit(" nation.")).alias("text"))
    return extract.mentions(said, extract.registry(names)).select("doc_id", "start", "surface")


@query()
def link_query_longest(spark, d):
    p = i.table(spark, d, "part")
    names = extract.registry(p.select(F.lit("part").alias("entity_type"), F.col("p_name").alias("name")))
    asked = p.select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("which "), "p_name", F.lit(" and more?")).alias("query"))
    return extract.link(asked, names).select("query_id", "start", "surface", F.size("candidates").alias("n_candidates"))


@query(r"SELECT doc_id, CAST(a + length(regexp_extract(l, '^\s*')) AS INTEGER) AS start, t AS text FROM (SELECT *, regexp_replace(l, '^\s+|\s+$', '', 'g') AS t FROM (SELECT doc_id, l, sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY o) - length(l) - 1 AS a FROM (SELECT doc_id, unnest(range(len(p))) AS o, unnest(p) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)))) WHERE t <> '' AND NOT regexp_matches(t, '^#{1,6}(\s|$)')")
def statement_lines(spark, d):
    return statements.statements(i.documents(spark, d), "doc_id").select("doc_id", "start", "text")


def _said(spark, d):
    """Statements as documents, each of one chunk."""
    docs = i.statements(spark, d).select(F.col("statement_id").alias("document_id"), F.col("statement").alias("text"))
    return docs, docs.select(F.col("document_id").alias("chunk_id"), "document_id", F.lit(0).alias("start"), F.length("text").alias("end"), "text")


def _told(out, key: str):
    """Relations by the names of their ends, and issues, as rows."""
    name = lambda end: out["entities"].select(F.col("entity_id").alias(f"{end}_id"), F.col("key").alias(end))
    rows = out["relations"].join(name("subject"), "subject_id").join(name("object"), "object_id").select(F.col(key).alias("statement_id"), F.lit(None).cast("string").alias("issue"), "predicate", "subject", "object")
    return rows.unionByName(out["issues"].select(F.col(key).alias("statement_id"), "issue"), allowMissingColumns=True)


@query(f"WITH {_SAID} SELECT statement_id, CASE kind WHEN 2 THEN 'unmatched_statement' END AS issue, predicate, subject, object FROM said")
def rule_extraction(spark, d):
    return _told(statements.extract_rules(*_said(spark, d), i.NAMED_RULES), "document_id")


@query(f"WITH {_SAID} SELECT key, count(*) AS n FROM (SELECT subject AS key FROM said WHERE kind < 2 UNION ALL SELECT object FROM said WHERE kind < 2) GROUP BY 1")
def rule_mentions(spark, d):
    out = statements.extract_rules(*_said(spark, d), i.NAMED_RULES)
    return out["mentions"].join(out["entities"].select("entity_id", "key"), "entity_id").groupBy("key").agg(F.count("*").alias("n"))


@query(f"WITH {_SAID}, r AS (SELECT *, CASE WHEN statement_id % 7 = 0 THEN 'invalid_json' WHEN kind = 2 THEN 'none' WHEN statement_id % 5 = 0 THEN 'invalid_quote' END AS issue FROM said) SELECT statement_id, issue, CASE WHEN issue IS NULL THEN predicate END AS predicate, CASE WHEN issue IS NULL THEN subject END AS subject, CASE WHEN issue IS NULL THEN object END AS object FROM r WHERE issue IS DISTINCT FROM 'none'")
def model_extraction(spark, d):
    _, chunks = _said(spark, d)
    return _told(proposals.process(chunks, i.receipts(chunks), i.ONTOLOGY), "document_id")


_REVIEWS = "rev AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' WHEN 2 THEN 'revise' ELSE 'later' END AS decision, doc_id % 3 = 0 AS independent, toxic = 0 AS checked FROM labels)"


@query(f"WITH {_REVIEWS} SELECT doc_id, CASE decision WHEN 'later' THEN 'no decision' WHEN 'pending' THEN 'pending but attested' ELSE 'approved without every check' END AS fault FROM rev WHERE decision = 'later' OR (decision = 'pending' AND independent) OR (decision = 'approved' AND NOT (independent AND checked)) UNION ALL SELECT doc_id, 'reviewed twice' FROM rev GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT DISTINCT doc_id, 'not reviewed' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM rev) UNION ALL SELECT doc_id, 'unknown' FROM rev WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def review_faults(spark, d):
    return reviews.faults(i.reviews(spark, d), i.documents(spark, d), "doc_id")


@query(f"WITH {_REVIEWS} SELECT count(*) FILTER (decision = 'pending') AS pending, count(*) FILTER (decision = 'approved') AS approved, count(*) FILTER (decision = 'revise') AS revise, count(*) AS subjects, count(*) FILTER (decision = 'approved') = count(*) AS all_approved, false AS reviewer_identity_authenticated, CAST(0 AS BIGINT) AS held_out FROM rev")
def review_decisions(spark, d):
    return reviews.decisions(i.reviews(spark, d))


@query(f"WITH {_GOLD}, {_SENT}, seen AS (SELECT DISTINCT question_id FROM gold JOIN chunks USING (doc_id) WHERE c_start <= s AND e <= c_end) SELECT 'documents' AS what, CAST(NULL AS VARCHAR) AS value, count(*) AS n FROM documents UNION ALL SELECT 'chunks', NULL, count(*) FROM chunks UNION ALL SELECT 'questions', NULL, count(*) FROM benchmark UNION ALL SELECT 'documents with evidence', NULL, count(DISTINCT doc_id) FROM gold UNION ALL SELECT 'uncovered questions', NULL, count(*) FROM benchmark WHERE item_id NOT IN (SELECT question_id FROM seen)")
def coverage_audit(spark, d):
    spans, chunks = i.gold(spark, d), i.chunks(spark, d)
    seen = intervals.containing(spans, chunks.select("doc_id", "chunk_id", F.col("start").alias("c_start"), F.col("end").alias("c_end"))).select("question_id", F.lit(True).alias("complete"))
    return reviews.audit(i.documents(spark, d), chunks, i.questions(spark, d), spans, seen)


# reports


@query(f"WITH {_RUNS} SELECT strategy, k, qtype, hops, docs, count(*) AS samples, count(DISTINCT question_id) AS questions, round(avg(CASE WHEN complete THEN 1.0::DOUBLE ELSE 0 END), 6) AS complete_rate, round(avg(coverage), 6) AS coverage, round(quantile_cont(ms, 0.5), 6) AS median_ms, round(quantile_cont(ms, 0.95), 6) AS p95_ms FROM runs GROUP BY GROUPING SETS ((strategy, k), (strategy, k, qtype), (strategy, k, hops), (strategy, k, docs))")
def summary_grouping_sets(spark, d):
    return _rounded(context.summarize(i.runs(spark, d)), "complete_rate", "coverage", "median_ms", "p95_ms").drop("gid")


@query(f"WITH {_RUNS}, e AS (SELECT k, question_id, avg(CASE WHEN complete THEN 1.0::DOUBLE ELSE 0 END) FILTER (strategy = 'click') AS a, avg(CASE WHEN complete THEN 1.0::DOUBLE ELSE 0 END) FILTER (strategy = 'view') AS b FROM runs GROUP BY 1, 2) SELECT k, round(avg(a - b), 6) AS difference, count(*) FILTER (a > b) AS wins, count(*) FILTER (a = b) AS ties, count(*) FILTER (a < b) AS losses FROM e WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1")
def paired_diff(spark, d):
    return _rounded(context.paired(i.runs(spark, d), "click", "view"), "difference")


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms FROM events GROUP BY 1")
def latency_percentiles(spark, d):
    return _rounded(i.table(spark, d, "events").groupBy("event_type").agg(F.percentile("value", 0.5).alias("median_ms"), F.percentile("value", 0.95).alias("p95_ms")), "median_ms", "p95_ms")


@query("SELECT user_id, CASE WHEN count(*) > 1 THEN count(DISTINCT event_type) = 1 END AS repeatable FROM events GROUP BY 1")
def stability_check(spark, d):
    return context.repeatable(i.table(spark, d, "events"), ["user_id"], ["event_type"])


@query("SELECT sha256(string_agg(n_nationkey || '|' || n_name, chr(10) ORDER BY n_nationkey)) AS fingerprint FROM nation")
def fingerprint(spark, d):
    return context.fingerprint(i.table(spark, d, "nation"), ["n_nationkey"], ["n_nationkey", "n_name"])


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def review_counts(spark, d):
    return i.table(spark, d, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query("SELECT lang, count(*) AS documents, count(DISTINCT source) AS sources, count(DISTINCT l.doc_id) AS labelled FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1")
def audit_counts(spark, d):
    lab = i.table(spark, d, "labels").select("doc_id", F.col("doc_id").alias("labelled"))
    return i.table(spark, d, "documents").select("doc_id", "lang", "source").join(lab, "doc_id", "left").groupBy("lang").agg(F.count("*").alias("documents"), F.count_distinct("source").alias("sources"), F.count_distinct("labelled").alias("labelled"))


@query("SELECT conv_id, turn, CAST(floor((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) / 3) AS BIGINT) AS batch FROM conversations")
def batch_sections(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return i.table(spark, d, "conversations").select("conv_id", "turn", F.floor((F.row_number().over(w) - 1) / 3).alias("batch"))


# answers


@query(f"WITH {_GOLD} SELECT question_id, doc_id, CASE WHEN n = 1 THEN s END AS start FROM (SELECT g.question_id, g.doc_id, g.s, (length(d.text) - length(replace(d.text, b.text, ''))) / length(b.text) AS n FROM gold g JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = g.question_id)")
def quote_unique(spark, d):
    quotes = i.gold(spark, d).select("question_id", "doc_id").join(i.questions(spark, d).withColumnRenamed("query", "quote"), "question_id")
    return answers.quote_spans(quotes, i.documents(spark, d)).select("question_id", "doc_id", "start")


@query("SELECT conv_id AS answer_id, count(*) AS citations, bool_and(length(text) >= 8 AND (length(text) - length(replace(text, left(text, 8), ''))) / 8 = 1) AND count(DISTINCT turn || left(text, 8)) = count(*) AS valid FROM conversations WHERE length(text) > 0 GROUP BY 1")
def citation_validate(spark, d):
    c = i.table(spark, d, "conversations").where("length(text) > 0")
    cites = c.select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("source_id"), F.substring("text", 1, 8).alias("quote"))
    return answers.validate_citations(cites, c.select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("source_id"), "text"))


@query("SELECT event_id, sha256(props) AS request_sha256, 'len:' || length(props) AS response FROM events")
def completion_cache(spark, d):
    e = i.table(spark, d, "events").select("event_id", F.col("props").alias("request"))
    cache = e.where("event_id % 2 = 0").select(F.sha2("request", 256).alias("request_sha256"), F.concat(F.lit("len:"), F.length("request").cast("string")).alias("response")).dropDuplicates(["request_sha256"])
    return answers.complete(e, lambda x: f"len:{len(x)}", cache).select("event_id", "request_sha256", "response")


@query("SELECT event_id AS id, true AS ok, CAST(NULL AS VARCHAR) AS issue FROM events")
def strict_json(spark, d):
    e = i.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("props").alias("response"))
    fields = set(answers.strict_json(e.first()["response"]))
    return answers.parse(e, fields)
