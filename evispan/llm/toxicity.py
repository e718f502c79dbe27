"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, weighted votes, calibration."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from evispan.llm._common import cut, drop_cut, slices

_WORD = re.compile(r"\w+")
#: Entries of a task's table of units before it is emptied: memory only, never a result.
MEMO = 100_000


@dataclass(frozen=True)
class Params:
    """Bounds of what is fitted on labelled rows, and the vote.

    ``positives`` and ``negatives``: labelled examples kept at most, by hash of their id. ``least_odds``: terms are all those of the
    examples whose log odds ratio for the label, less 1.5 standard errors, is so large; there is no bound on their number but the
    examples'. ``stems``: lengths of word beginnings that are terms beside whole words. ``k`` neighbours vote by their cosine; ``prior_weight`` is
    that of the base rate among them. ``block``: examples a block of the index.
    """

    positives: int = 3000
    negatives: int = 7000
    least_odds: float = 1.0
    stems: tuple[int, ...] = (5, 6)
    k: int = 15
    prior_weight: float = 0.5
    block: int = 64
    threshold: float = 0.7


def unit_terms(unit: str, stems: tuple[int, ...]) -> list[str]:
    """A unit's words in lower case, and their beginnings with a sign behind."""
    unit = unit.lower()
    out = [unit] if unit.isalnum() else _WORD.findall(unit)
    return out + [f"{w[:n]}*" for w in out for n in stems if len(w) > n]


class Units:
    """Rows of the lexicon that a unit (a part of a text between white space) has; units without any are told apart fast."""

    def __init__(self, row: dict[str, int], stems: tuple[int, ...]):
        self.row, self.stems = row, stems
        self.hits: dict[str, list[int]] = {}
        self.none: set[str] = set()

    def __call__(self, units: list[str]) -> list[tuple[str, list[int]]]:
        hits, none, row, out = self.hits, self.none, self.row, []
        if len(none) > MEMO:
            none.clear()
        if len(hits) > MEMO:
            hits.clear()
        for u in set(units).difference(none):
            if (rows := hits.get(u)) is None:
                rows = [row[t] for t in unit_terms(u, self.stems) if t in row]
                if not rows:
                    none.add(u)
                    continue
                hits[u] = rows
            out.append((u, rows))
        return out

    def counts(self, text: str) -> dict[int, int]:
        """Rows of the lexicon that a text has, and how often."""
        units, tf = text.split(), Counter()
        if hits := self(units):
            times = Counter(units)
            for u, rows in hits:
                for r in rows:
                    tf[r] += times[u]
        return tf


def is_held_out(key: Column) -> Column:
    """Rows never learnt from: crc32 of the id as text leaves 1 on division by 3. A null id is learnt from nowhere either."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class BlockMaxIndex:
    """Inverted index of unit vectors, cut into blocks of examples, with each term's largest weight in each block.

    The sum of those over a query's terms bounds the cosine of anything in a block; blocks are scored by falling
    bound until the k-th best cosine found is as large, so the k nearest are exact.
    """

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int):
        self.block, self.n = block, len(rows)
        blocks = -(-self.n // block)
        term = np.concatenate([t for t, _ in rows] or [np.empty(0, np.int64)]).astype(np.int64)
        doc = np.repeat(np.arange(self.n), [len(t) for t, _ in rows]) if rows else np.empty(0, np.int64)
        weight = np.concatenate([w for _, w in rows] or [np.empty(0)])
        order = np.lexsort((doc, term))
        self.doc, self.weight = doc[order], weight[order]
        cell = term[order] * blocks + self.doc // block
        self.most = np.zeros((n_terms, blocks))
        np.maximum.at(self.most.reshape(-1), cell, self.weight)
        self.start = np.searchsorted(cell, np.arange(n_terms * blocks)).reshape(n_terms, blocks)
        self.end = np.searchsorted(cell, np.arange(n_terms * blocks), "right").reshape(n_terms, blocks)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest cosine above 0, ties to the smaller place; ``skip`` takes no part."""
        if not len(terms) or not self.n:
            return np.empty(0, np.int64), np.empty(0)
        bound = weights @ self.most[terms]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        best_d, best_s = np.empty(0, np.int64), np.empty(0)
        at, step = 0, 8
        while at < len(order):
            if len(best_s) >= k and best_s[k - 1] > bound[order[at]] + 1e-12:
                break
            now = order[at : at + step]
            at, step = at + step, step * 4
            a, b = self.start[terms][:, now].ravel(), self.end[terms][:, now].ravel()
            size = b - a
            ends = np.cumsum(size)
            post = np.repeat(a - ends + size, size) + np.arange(ends[-1])
            docs, where = np.unique(self.doc[post], return_inverse=True)
            sums = np.bincount(where, self.weight[post] * np.repeat(np.repeat(weights, len(now)), size))
            keep = (sums > 0) & (docs != skip)
            best_d, best_s = np.concatenate([best_d, docs[keep]]), np.concatenate([best_s, sums[keep]])
            top = np.lexsort((best_d, -np.round(best_s, 12)))[:k]
            best_d, best_s = best_d[top], best_s[top]
        return best_d, best_s


class Model:
    """Examples, term weights and calibration; small enough to broadcast, as ``Params`` bounds each."""

    def __init__(self, p: Params, terms: list[str], idf: np.ndarray, examples: list[tuple[int, int, dict[int, int]]], rate: float):
        self.p, self.rate = p, min(max(rate, 1e-4), 1 - 1e-4)
        self.row = {t: i for i, t in enumerate(terms)}
        self.units = Units(self.row, p.stems)
        self.idf = idf
        made = [(key, y, self.vector(tf)) for key, y, tf in examples]
        made = [x for x in made if len(x[2][0])]
        # alike examples share a block, so that bounds are tight
        made.sort(key=lambda x: (*x[2][0][np.argsort(-x[2][1], kind="stable")][:3].tolist(), x[0]))
        self.ids, self.y = [x[0] for x in made], np.array([x[1] for x in made], float)
        self.index = BlockMaxIndex([x[2] for x in made], len(terms), p.block)
        self.a, self.b = 1.0, 0.0
        # examples without a term vote like any text without: by the base rate alone
        rest = Counter(y for _, y, tf in examples if not tf)
        votes = np.array([self.vote(*x[2], skip=i)[0] for i, x in enumerate(made)] + [self.rate] * (rest[0] + rest[1]))
        y = np.concatenate([self.y, np.ones(rest[1]), np.zeros(rest[0])])
        if 0 < y.sum() < len(y):
            # classes count as often as among all labelled rows, whatever the sample's share of each
            w = np.where(y == 1, self.rate / y.mean(), (1 - self.rate) / (1 - y.mean()))
            self.a, self.b = logistic(logit(votes), y, w)

    def vector(self, tf: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        rows = np.array(sorted(tf), np.int64)
        w = (1 + np.log(np.array([tf[r] for r in rows.tolist()], float))) * self.idf[rows] if len(rows) else np.empty(0)
        norm = np.sqrt((w * w).sum())
        return (rows, w / norm) if norm > 0 else (rows[:0], w[:0])

    def vote(self, terms: np.ndarray, weights: np.ndarray, skip: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        near, sim = self.index.nearest(terms, weights, self.p.k, skip)
        share = ((sim * self.y[near]).sum() + self.p.prior_weight * self.rate) / (sim.sum() + self.p.prior_weight)
        return float(share), near, sim

    def __call__(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """Score of a whole text and its three nearest examples: id, label, cosine."""
        tf = self.units.counts(text)
        share, near, sim = self.vote(*self.vector(tf)) if tf else (self.rate, (), ())
        score = float(1 / (1 + np.exp(-(self.a * logit(share) + self.b))))
        return score, [(self.ids[i], int(self.y[i]), float(s)) for i, s in zip(near[:3], sim[:3])]


def logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a weighted logistic regression with a slight ridge, by Newton's method; the slope isn't negative."""
    theta, X = np.array([1.0, 0.0]), np.stack([x, np.ones(len(x))], 1)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(X @ theta, -30, 30)))
        grad = X.T @ (w * (q - y)) + 0.1 * (theta - [1, 0])
        step = np.linalg.solve((X * (w * q * (1 - q))[:, None]).T @ X + 0.1 * np.eye(2), grad)
        theta = theta - np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return max(float(theta[0]), 0.0), float(theta[1])


def _document_frequencies(rows: DataFrame, p: Params) -> DataFrame:
    """Of each term, the numbers of examples with each label that have it: ``t, a`` (label 1) and ``b`` (label 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, own in slices(batches):
            n: tuple[Counter, Counter] = (Counter(), Counter())
            for text, y in zip(own, batch.column(0).to_pylist()):
                n[y].update({t for u in set(text.split()) for t in unit_terms(u, p.stems)})
            terms = list(n[0].keys() | n[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([n[y][t] for t in terms], pa.int64()) for y in (1, 0))], ["t", "a", "b"])

    return rows.select("y", "text").mapInArrow(run, "t string, a long, b long").groupBy("t").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _vectors(rows: DataFrame, terms: list[str], p: Params, kind: str) -> DataFrame:
    """For each example, the numbers of its terms that were selected and how often it has each."""
    lex = rows.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(lex.value, p.stems)
        for batch, own in slices(batches):
            tfs = [units.counts(t) for t in own]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([list(t) for t in tfs], pa.list_(pa.int32())), pa.array([list(t.values()) for t in tfs], pa.list_(pa.int32()))], ["doc_id", "y", "terms", "counts"])

    return rows.select("doc_id", "y", "text").mapInArrow(run, f"doc_id {kind}, y int, terms array<int>, counts array<int>")


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn from labelled rows that aren't held out.

    A document counts as toxic if any of its label rows says 1; rows without id or label are left out, and so are
    labels without document. The examples are a bounded sample (``Params``); the base rate is that of all labels that may
    be learnt from, and a term's document frequency is counted over all documents.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col("toxic").cast("int").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL").where(~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    draw = lambda y, n: known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    sample = draw(1, p.positives).unionByName(draw(0, p.negatives))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    sampled = cut(rows.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.max("y").alias("y"), F.min("text").alias("text")), "labelled")
    n = {r["y"]: r["n"] for r in sampled.groupBy("y").agg(F.count("*").alias("n")).collect()}
    odds = lambda c, y: F.log((F.col(c) + 0.5) / (n.get(y, 0) - F.col(c) + 0.5))
    error = F.sqrt(sum((1 / (F.col(c) + 0.5) + 1 / (n.get(y, 0) - F.col(c) + 0.5) for c, y in (("a", 1), ("b", 0))), F.lit(0.0)))
    lex = sorted(r["t"] for r in _document_frequencies(sampled, p).where("a > 0").where(odds("a", 1) - odds("b", 0) - 1.5 * error >= p.least_odds).select("t").collect())
    found = _vectors(sampled, lex, p, kind).toArrow()
    drop_cut(sampled)
    keys, ys = found.column("doc_id").to_pylist(), found.column("y").to_pylist()
    per = found.column("terms").to_pylist(), found.column("counts").to_pylist()
    examples = [(keys[i], ys[i], dict(zip(per[0][i], per[1][i]))) for i in sorted(range(len(keys)), key=lambda i: keys[i])]
    total, freq = _frequencies(rows, lex, p)
    idf = np.log((1 + total) / (1 + freq)) + 1
    labelled = sum(counts.values())
    return Model(p, lex, idf, examples, counts.get(1, 0) / labelled if labelled else 0.01)


def _frequencies(rows: DataFrame, terms: list[str], p: Params) -> tuple[int, np.ndarray]:
    """Number of all documents, and of those with each of the (bounded) terms. A task passes on one row a term."""
    lex = rows.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, units = np.zeros(len(lex.value) + 1, np.int64), Units(lex.value, p.stems)
        for _, own in slices(batches):
            for text in own:
                n[list({r for _, rows in units(text.split()) for r in rows})] += 1
                n[-1] += 1
        has = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(has, pa.int64()), pa.array(n[has], pa.int64())], ["i", "n"])

    out = np.zeros(len(terms) + 1, np.int64)
    for r in rows.select("text").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        out[r["i"]] = r["n"]
    return int(out[-1]), out[:-1]


def score(docs: DataFrame, labels: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Score every whole text: ``doc_id, held_out, score, predicted, evidence``, and under ``row`` the columns of ``docs``
    that ``carry`` names (all by default).

    ``score`` is from 0 to 1; ``predicted`` is 1 from ``Params.threshold`` on; ``evidence`` has the nearest labelled examples
    with label and cosine, none where a text has no term that tells labels apart. Null texts score like empty ones. Only the
    text is an input of a score. Repeated rows each give a row; empty tables give none; without labels every score is
    the base rate of 0.01. One pass without shuffle; the broadcast model is bounded by ``Params``.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, p, id_col, text_col))
    key, carried = F.col(f"`{id_col}`"), docs.columns if carry is None else carry or [id_col]
    # the text goes to Python once, and comes back only if it is carried
    whole = docs.schema[text_col].dataType == StringType() and text_col in carried
    text = F.col(f"`{text_col}`") if whole else F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rest = [F.col(f"`{c}`") for c in carried if not (whole and c == text_col)]
    rows = docs.select(text.alias("text"), key.alias("doc_id"), is_held_out(key).alias("held_out"), F.struct(*rest, F.lit(0).alias("_")).alias("row"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    scored = pa.struct([("example", pa.string()), ("label", pa.int32()), ("cosine", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch, own in slices(batches):
            got = [m(t or "") for t in own]
            evidence = pa.array([[{"example": str(i), "label": y, "cosine": s} for i, y, s in e] for _, e in got], pa.list_(scored))
            arrays = [batch.column(1), batch.column(2), batch.column(3), pa.array([s for s, _ in got], pa.float64()), pa.array([int(s >= p.threshold) for s, _ in got], pa.int32()), evidence]
            yield pa.RecordBatch.from_arrays(arrays + [batch.column(0)] * whole, ["doc_id", "held_out", "row", "score", "predicted", "evidence"] + ["text"] * whole)

    out = rows.mapInArrow(run, f"doc_id {kinds['doc_id']}, held_out boolean, row {kinds['row']}, score double, predicted int, evidence array<struct<example:string,label:int,cosine:double>>" + ", text string" * whole)
    back = F.struct(*[(F.col("text") if whole and c == text_col else F.col(f"row.`{c}`")).alias(c) for c in carried])
    return out.select("doc_id", "held_out", back.alias("row"), "score", "predicted", "evidence")
