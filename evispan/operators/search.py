"""Rankings: BM25, exact cosine, weighted reciprocal rank fusion. Ranks are columns; ties go to the smaller id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from pyspark.sql.pandas.types import from_arrow_type

from evispan.functions.text import tokenize


def top_k(df: DataFrame, by: list[str], k: int, score: str = "score", key: str = "chunk_id") -> DataFrame:
    """The ``k`` best of each group with their rank; a window that Spark limits before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(key))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def postings(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """``key, len, term, tf``: a row a chunk and term; chunks without words have none."""
    words = chunks.select(F.col(key), tokenize(F.col(text)).alias("ts"))
    return words.select(key, F.size("ts").alias("len"), F.explode("ts").alias("term")).groupBy(key, "len", "term").agg(F.count("*").alias("tf"))


#: Pairs of query and term up to which a query set goes to every task; beyond, postings and queries are joined.
QUERY_TERMS = 1_000_000


def bm25(chunks: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75, key: str = "chunk_id", text: str = "text", query: str = "query_id", query_text: str = "query") -> DataFrame:
    """``query, chunk, score, rank``: sum over a query's distinct terms of ln(1 + (N - df + 1/2) / (df + 1/2)) * tf (k1 + 1) / (tf + k1 (1 - b + b len / avg)).

    Only positive scores, ties (to nine digits) to the smaller chunk. N counts chunks without words too. A query set of at most
    ``QUERY_TERMS`` terms, which is checked, goes to every task: one pass counts, a second scores each chunk where it is read, and
    the shuffle carries k rows a query and task. A larger set is joined with the postings instead; both give the same rows.
    """
    if k < 1 or not k1 > 0 or not 0 <= b <= 1:
        raise ValueError("k >= 1, k1 > 0 and 0 <= b <= 1 are needed")
    asked = queries.select(F.col(query), F.explode(F.array_distinct(tokenize(F.col(query_text)))).alias("term")).distinct()
    words = chunks.select(F.col(key), tokenize(F.col(text)).alias("ts"))
    own = asked.limit(QUERY_TERMS + 1).toArrow()
    if own.num_rows <= QUERY_TERMS:
        return _scan(words, own, k, k1, b, key, query)
    stats = words.agg(F.count("*").alias("n"), F.avg(F.size("ts").cast("double")).alias("avg"))
    terms = asked.select("term").distinct()
    tf = words.select(key, F.size("ts").alias("len"), F.explode("ts").alias("term")).join(terms, "term", "left_semi").groupBy(key, "len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log1p((F.col("n") - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
    part = idf * F.col("tf") * F.lit(k1 + 1) / (F.col("tf") + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("len") / F.col("avg")))
    scored = tf.join(df, "term").join(asked, "term").crossJoin(F.broadcast(stats)).groupBy(query, key).agg(F.round(F.sum(part), 9).alias("score"))
    return top_k(scored.where("score > 0"), [query], k, key=key)


def _frequencies(ts: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lists of words: each list's length, and row, term number and count of the asked terms in it."""
    lens = pc.fill_null(pc.list_value_length(ts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    number = pc.fill_null(pc.index_in(ts.flatten(), value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    found = np.flatnonzero(number >= 0)
    cell, tf = np.unique(np.repeat(np.arange(len(lens)), lens)[found] * len(terms) + number[found], return_counts=True)
    return lens, cell // len(terms), cell % len(terms), tf


def _scan(words: DataFrame, asked: pa.Table, k: int, k1: float, b: float, key: str, query: str) -> DataFrame:
    """``bm25`` of a bounded query set over ``key, ts``."""
    spark, kinds = words.sparkSession, {f.name: f.dataType.simpleString() for f in words.schema.fields}
    ids, terms = asked.column(0).combine_chunks().dictionary_encode(), asked.column(1).combine_chunks().dictionary_encode()
    names, terms, qs, ts_ = ids.dictionary, terms.dictionary, ids.indices.to_numpy(), terms.indices.to_numpy()
    schema = f"{query} {_kind(names.type)}, {key} {kinds[key]}, score double"
    if not len(names):
        return spark.createDataFrame([], schema + ", rank int")
    order = np.argsort(ts_, kind="stable")
    qs, first = qs[order].astype(np.int64), np.searchsorted(ts_[order], np.arange(len(terms) + 1))
    shared = spark.sparkContext.broadcast((names, terms, qs, first))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(terms) + 2, np.int64)
        for batch in batches:
            lens, _, t, _ = _frequencies(batch.column(1), shared.value[1])
            n[:-2] += np.bincount(t, minlength=len(n) - 2)
            n[-2:] += len(lens), lens.sum()
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["i", "n"])

    seen = np.zeros(len(terms) + 2, np.int64)
    for r in words.mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        seen[r["i"]] = r["n"]
    n, avg = seen[-2], seen[-1] / max(seen[-2], 1)
    idf = np.log1p((n - seen[:-2] + 0.5) / (seen[:-2] + 0.5))
    rows = max(1, 2_000_000 // len(names))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, terms, qs, first = shared.value
        best, least = None, np.zeros(len(names))  # query, score, chunk; the k-th best score of each query so far
        for batch in batches:
            for a in range(0, batch.num_rows, rows):
                own = batch.slice(a, rows)
                lens, c, t, tf = _frequencies(own.column(1), terms)
                part = idf[t] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lens[c] / max(avg, 1e-300)))
                many = first[t + 1] - first[t]
                ends = np.cumsum(many)
                at = np.repeat(np.arange(len(t)), many)
                q = qs[np.arange(len(at)) - np.repeat(ends - many, many) + first[t][at]]
                sums = np.round(np.bincount(c[at] * len(names) + q, part[at], own.num_rows * len(names)), 9).reshape(-1, len(names))
                c, q = np.nonzero((sums > 0) & (sums >= least))
                chunks = np.array(own.column(0).take(pa.array(c)).to_pylist(), object)
                new = q, sums[c, q], chunks
                best = new if best is None else tuple(np.concatenate(x) for x in zip(best, new))
                by = np.lexsort((best[2], -best[1], best[0]))
                by = by[np.arange(len(by)) - np.searchsorted(best[0][by], best[0][by]) < k]
                best = tuple(x[by] for x in best)
                full = np.bincount(best[0], minlength=len(names)) == k
                least[full] = best[1][np.searchsorted(best[0], np.flatnonzero(full), "right") - 1]
        if best is not None:
            yield pa.RecordBatch.from_arrays([names.take(pa.array(best[0])), pa.array(best[2].tolist()), pa.array(best[1])], [query, key, "score"])

    return top_k(words.mapInArrow(score, schema), [query], k, key=key)


def _kind(kind: pa.DataType) -> str:
    return from_arrow_type(kind).simpleString()


def normalize(v: Column) -> Column:
    """Unit vector; a zero or non-finite vector is an error."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    checked = F.when((norm > 0) & (norm < F.lit(float("inf"))), norm).otherwise(F.raise_error(F.lit("a vector is zero or not finite")).cast("double"))
    return F.transform(v, lambda x: x.cast("double") / checked)


#: Bytes of query vectors up to which a query set goes to every task.
QUERY_BYTES = 64_000_000


def cosine(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", query: str = "query_id") -> DataFrame:
    """Exact cosine of every row with every query of a stated set, cut to [-1, 1], the ``k`` best of each query, negatives kept.

    A query set of at most ``QUERY_BYTES``, which is checked, goes to every task as one matrix; a task keeps the ``k`` best of each query in
    numpy, and the shuffle carries k rows a query and task. A larger set meets the rows block by block (``cosine_blocked``).
    """
    asked = queries.select(F.col(query).cast("long").alias("q"), normalize(F.col(vector)).alias("v"))
    size = queries.agg(F.sum(F.size(vector).cast("long") * 8)).first()[0] or 0
    if size > QUERY_BYTES:
        return cosine_blocked(vectors, queries, k, key, vector, query)
    own = asked.toArrow()
    ids, matrix = own.column(0).to_numpy(), own.column(1).combine_chunks().flatten().to_numpy().reshape(own.num_rows, -1) if own.num_rows else np.empty((0, 0))
    shared = vectors.sparkSession.sparkContext.broadcast((ids, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        best = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)  # query, row, cosine
        rows = max(1, 2_000_000 // max(1, len(ids)))
        for batch in batches:
            for a in range(0, batch.num_rows if len(ids) else 0, rows):
                part = batch.slice(a, rows)
                sim = np.round(np.clip(part.column(1).flatten().to_numpy().reshape(part.num_rows, -1) @ matrix.T, -1, 1), 9)
                edge = -np.partition(-sim, min(k, len(sim)) - 1, 0)[min(k, len(sim)) - 1]
                r, q = np.nonzero(sim >= edge)
                best = tuple(np.append(x, y) for x, y in zip(best, (q, part.column(0).to_numpy()[r], sim[r, q])))
                by = np.lexsort((best[1], -best[2], best[0]))
                by = by[np.arange(len(by)) - np.searchsorted(best[0][by], best[0][by]) < k]
                best = tuple(x[by] for x in best)
        yield pa.RecordBatch.from_arrays([pa.array(ids[best[0]]), pa.array(best[1]), pa.array(best[2])], [query, key, "score"])

    rows = vectors.select(F.col(key).cast("long").alias(key), normalize(F.col(vector)).alias("v"))
    return top_k(rows.mapInArrow(run, f"{query} long, {key} long, score double"), [query], k, key=key)


def _blocks(df: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """Unit vectors packed ``width`` to a row, as bytes: ``ids, vs``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, width):
                own = batch.slice(a, width)
                yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy().tobytes()], pa.binary()) for c in (own.column(0), own.column(1).flatten())], ["ids", "vs"])

    return df.select(F.col(key).cast("long").alias("i"), normalize(F.col(vector)).alias("v")).mapInArrow(pack, "ids binary, vs binary")


def cosine_blocked(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", query: str = "query_id", width: int = 256) -> DataFrame:
    """``cosine`` where the queries are as many as the rows: every block of rows meets every block of queries, all pairs are worked out.

    A task keeps the ``k`` best of each query of its blocks; a pair under the worst of them goes no further. Time grows with rows times queries.
    """
    n = vectors.sparkSession.sparkContext.defaultParallelism
    rows = _blocks(vectors, key, vector, width).repartition(n)
    asked = _blocks(queries, query, vector, width).repartition(4 * n).toDF("q", "qv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, tuple] = {}

        def out() -> pa.RecordBatch:
            got = [pa.array(np.concatenate(c)) for c in zip(*((np.frombuffer(q, np.int64)[j], i, s) for q, (j, i, s, _) in best.items()))]
            best.clear()
            return pa.RecordBatch.from_arrays(got, [query, key, "score"])

        for batch in batches:
            for ids, vs, q, qv in zip(*(batch.column(c).to_pylist() for c in range(4))):
                ids = np.frombuffer(ids, np.int64)
                m = len(q) // 8
                sim = np.round(np.clip(np.frombuffer(qv).reshape(m, -1) @ np.frombuffer(vs).reshape(len(ids), -1).T, -1, 1), 9)
                j, i, s, least = best.get(q) or (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.full(m, -np.inf))
                a, b = np.nonzero(sim >= least[:, None])
                j, i, s = np.append(j, a), np.append(i, ids[b]), np.append(s, sim[a, b])
                by = np.lexsort((i, -s, j))
                place = np.arange(len(by)) - np.searchsorted(j[by], j[by])
                by = by[place < k]
                j, i, s = j[by], i[by], s[by]
                least = np.full(m, -np.inf)
                full = np.flatnonzero(np.bincount(j, minlength=m) == k)
                least[full] = s[np.searchsorted(j, full, side="right") - 1]
                best[q] = j, i, s, least
                if len(best) > 1000:
                    yield out()
        if best:
            yield out()

    met = rows.join(asked, F.lit(True))
    return top_k(met.mapInArrow(run, f"{query} long, {key} long, score double"), [query], k, key=key)


def fuse(first: DataFrame, second: DataFrame, by: list[str], weights: tuple[float, float] = (1.0, 1.0), constant: int = 60, key: str = "chunk_id") -> DataFrame:
    """Reciprocal rank fusion: full outer join on ``by`` and ``key``, score w1 / (c + rank1) + w2 / (c + rank2), a missing term 0; zero scores go."""
    if min(weights) < 0 or max(weights) == 0 or constant < 0:
        raise ValueError("weights must not be negative or both zero, nor the constant negative")
    a = first.select(*by, key, F.col("rank").alias("first_rank"))
    b = second.select(*by, key, F.col("rank").alias("second_rank"))
    term = lambda w, c: F.coalesce(F.lit(float(w)) / (F.lit(float(constant)) + F.col(c)), F.lit(0.0))
    out = a.join(b, [*by, key], "full_outer").withColumn("score", term(weights[0], "first_rank") + term(weights[1], "second_rank")).where("score > 0")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc(key))))


def shallowest(hits: DataFrame, wanted: DataFrame, by: list[str], key: str = "chunk_id") -> DataFrame:
    """Rank of the best of the wanted chunks, and the depth at which all are seen (null if some never is)."""
    n = wanted.groupBy(*by).agg(F.count("*").alias("n"))
    seen = hits.join(wanted, [*by, key], "left_semi").groupBy(*by).agg(F.min("rank").alias("first_rank"), F.max("rank").alias("last"), F.count("*").alias("found"))
    return n.join(seen, by, "left").select(*by, "first_rank", F.when(F.col("found") == F.col("n"), F.col("last")).alias("group_rank"))
