"""The engine's concepts over the supplied tables: chunks, questions, gold spans, hits, graph edges, statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evispan import config
from evispan.functions import text as t
from evispan.operators import proposals, search


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence segments with more than white space: ``chunk_id`` orders by document and place."""
    s = t.sentences(documents(spark, sf_dir)).where(F.trim(F.regexp_replace("text", r"[\t\n\r\f]", " ")) != "")
    return s.withColumn("chunk_id", F.format_string("%012d:%06d", "doc_id", "ordinal"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("query"))


#: Passages without an inner word that one block holds beside the documents.
BLOCK = 1000


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First place where a question's passage lies in a document: each such document is one sufficient set of one fact.

    A word with white space on both sides in the passage is a whole word of any text that holds it, wherever the passage begins or ends. Passages
    are keyed by the longest such word and met by a hash join on the documents' words; the whole passage is compared after. Those of one or two words
    have none: they are asked of all documents in blocks of ``BLOCK``. Empty passages lie nowhere.
    """
    inner = F.filter(F.split("query", r"\s+"), lambda x, i: (i > 0) & (i < F.size(F.split("query", r"\s+")) - 1))
    longest = F.aggregate(inner, F.lit(None).cast("string"), lambda acc, x: F.when(acc.isNull() | (F.length(x) > F.length(acc)), x).otherwise(acc))
    q = questions(spark, sf_dir).where(F.length("query") > 0).withColumn("key", longest)
    d = documents(spark, sf_dir)
    whole = q.where("key IS NOT NULL")
    keys = d.select("doc_id", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("key")).join(whole.select("key").distinct(), "key", "left_semi")
    hit = keys.join(whole, "key").select("doc_id", "question_id", "query").join(d, "doc_id").where(F.instr(F.col("text"), F.col("query")) > 0)
    short = q.where("key IS NULL").select("question_id", "query")
    blocks = -(-short.count() // BLOCK)
    for n in range(blocks):
        own = short.where(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == n)
        hit = hit.unionByName(d.join(F.broadcast(own), F.instr(F.col("text"), F.col("query")) > 0))
    start = F.instr(F.col("text"), F.col("query")) - 1
    return hit.select("question_id", "doc_id", start.alias("start"), (start + F.length("query")).alias("end"))


def bm25_hits(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    return search.bm25(chunks(spark, sf_dir), questions(spark, sf_dir), k, query="question_id")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def vectors_as_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of the table as a query."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star schema's keys as typed edges."""
    read = lambda n: table(spark, sf_dir, n)
    node = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    rows = [
        read("nation").select(F.concat(F.lit("nr:"), F.col("n_nationkey").cast("string")).alias("edge_id"), node("n", "n_nationkey").alias("src"), F.lit("in_region").alias("predicate"), node("r", "n_regionkey").alias("dst")),
        read("supplier").select(F.concat(F.lit("sn:"), F.col("s_suppkey").cast("string")), node("s", "s_suppkey"), F.lit("in_nation"), node("n", "s_nationkey")),
        read("customer").select(F.concat(F.lit("cn:"), F.col("c_custkey").cast("string")), node("c", "c_custkey"), F.lit("in_nation"), node("n", "c_nationkey")),
        read("orders").select(F.concat(F.lit("oc:"), F.col("o_orderkey").cast("string")), node("o", "o_orderkey"), F.lit("placed_by"), node("c", "o_custkey")),
        read("lineitem").select(F.concat_ws(":", F.lit("ls"), "l_orderkey", "l_linenumber"), node("o", "l_orderkey"), F.lit("supplied_by"), node("s", "l_suppkey")),
    ]
    out = rows[0]
    for x in rows[1:]:
        out = out.unionAll(x)
    return out


RULES = [
    {"rule_id": "r1", "pattern": r"(\S+) is in the (.+) nation\.", "predicate": "in_nation", "subject_type": "customer", "object_type": "nation"},
    {"rule_id": "r2", "pattern": r"(\S+) buys as (.+)\.", "predicate": "segment", "subject_type": "customer", "object_type": "segment"},
    {"rule_id": "r3", "pattern": r"(\S+) is (.+)\.", "predicate": "is", "subject_type": "customer", "object_type": "thing"},
]


NAMED_RULES = config.Rules((
    config.Rule("r1", r"(?P<subject>\S+) is in the (?P<object>.+) nation\.", "customer", "nation", "in_nation"),
    config.Rule("r2", r"(?P<subject>\S+) buys as (?P<object>.+)\.", "customer", "segment", "segment"),
))

ONTOLOGY = config.ModelExtraction(
    config.LocalModel("none/none", "0" * 40),
    {"customer": "who buys", "nation": "a nation", "segment": "a part of the market"},
    (config.RelationKind("in_nation", "where a customer is", ("customer",), ("nation",)), config.RelationKind("segment", "what a customer buys as", ("customer",), ("segment",))),
)


def receipts(chunks: DataFrame) -> DataFrame:
    """What a model might have replied to each chunk of ``statements``: every seventh reply is broken, every fifth quotes other words."""
    n, text = F.col("chunk_id"), F.col("text")
    end = lambda i, name, kind: F.struct(F.lit(i).alias("id"), name.alias("name"), kind.alias("entity_type"))
    nation = text.contains(" is in the ")
    other = F.when(nation, F.regexp_extract(text, r" is in the (.+) nation", 1)).otherwise(F.regexp_extract(text, r" buys as (.+)\.", 1))
    kind = F.when(nation, "nation").otherwise("segment")
    relation = F.struct(F.lit("e1").alias("subject"), F.when(nation, "in_nation").otherwise("segment").alias("predicate"), F.lit("e2").alias("object"), F.when(n % 5 == 0, "other words").otherwise(text).alias("quote"))
    body = F.to_json(F.struct(F.array(end("e1", F.split(text, " ")[0], F.lit("customer")), end("e2", other, kind)).alias("entities"), F.array(relation).alias("relations")))
    reply = F.when(n % 7 == 0, "{").when(text.endswith("account"), '{"entities":[],"relations":[]}').otherwise(body)
    return proposals.requests(chunks, ONTOLOGY).join(chunks.select("chunk_id", reply.alias("response")), "chunk_id").select("request_sha256", "response", F.lit("stop").alias("finished"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review rows made of labels: decisions by the id, every check by the label, every third reviewer independent."""
    lab, n = table(spark, sf_dir, "labels"), F.col("doc_id")
    decision = F.when(n % 4 == 0, "pending").when(n % 4 == 1, "approved").when(n % 4 == 2, "revise").otherwise("later")
    if_decided = lambda c: F.when(n % 4 > 0, c)
    attested = F.struct(*[if_decided(F.col("toxic") == 0).alias(c) for c in ("source_checked", "answer_supported")])
    return lab.select("doc_id", decision.alias("decision"), if_decided(F.lit("someone")).alias("reviewer"), if_decided(F.lit("2024-01-01").cast("date")).alias("reviewed_on"), (n % 3 == 0).alias("independent"), attested.alias("checks"), if_decided(F.lit("read")).alias("notes"))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences over real rows: a third fits one rule, a third two, a third none."""
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    said = F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit(" buys as "), "c_mktsegment", F.lit("."))).when(F.col("c_custkey") % 3 == 1, F.concat("c_name", F.lit(" is in the "), "n_name", F.lit(" nation."))).otherwise(F.concat("c_name", F.lit(" has an account")))
    return c.select(F.col("c_custkey").alias("statement_id"), said.alias("statement"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed samples for reports, from events: strategy, cutoff, question and attributes."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("strategy"), F.when(F.col("event_id") % 2 == 0, 5).otherwise(10).alias("k"), (F.col("user_id") % 40).alias("question_id"), F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("qtype"), (F.col("user_id") % 2).cast("int").alias("hops"), (F.col("user_id") % 4).cast("int").alias("docs"), (F.col("event_id") % 3 == 0).alias("complete"), ((F.col("event_id") % 5) / F.lit(4.0)).alias("coverage"), F.col("value").alias("ms"))
