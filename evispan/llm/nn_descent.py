"""Approximate nearest neighbours: NN-descent graphs over cells of the vectors, and greedy search in them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from evispan.llm._common import cut, drop_cut


@dataclass(frozen=True)
class Params:
    """``k`` neighbours a node in a graph, ``sample`` of either direction in a round's joins; first neighbours from blocks of
    about ``block`` nodes along ``directions`` random directions; at most ``rounds`` rounds, ended when under ``settled`` of all
    edges are new. A search starts at the nearest of ``starts`` nodes, keeps ``beam`` nodes and expands ``expand`` of them a round.

    A graph has about ``rows`` nodes, fewer where a table is small or vectors are wide, so that tasks share the work and
    fit in memory. A query searches ``probes`` cells, those with the nearest centres, and ``share`` of all cells beyond those.
    """

    k: int = 24
    sample: int = 16
    block: int = 256
    directions: int = 3
    rounds: int = 8
    settled: float = 0.05
    beam: int = 144
    expand: int = 48
    starts: int = 1024
    rows: int = 32768
    probes: int = 32
    share: float = 0.25


# Edges of a graph and nodes of a beam are numbers that sort by owner, squared distance, node and whether they are new:
# 17 bits, 29 (a positive float's leading ones), 17 and 1.
_TO, _D, _ONE = np.uint64(47), np.uint64(18), np.uint64(1)
_NODE = np.uint64((1 << 17) - 1)
_MOST = 1 << 17


def _coded(to: np.ndarray, d2: np.ndarray, node: np.ndarray) -> np.ndarray:
    bits = (np.maximum(d2, 0).astype(np.float32).view(np.uint32) >> np.uint32(2)).astype(np.uint64)
    return (to.astype(np.uint64) << _TO) | (bits << _D) | (node.astype(np.uint64) << _ONE) | _ONE


def _to(keys: np.ndarray) -> np.ndarray:
    return (keys >> _TO).astype(np.int64)


def _node(keys: np.ndarray) -> np.ndarray:
    return ((keys >> _ONE) & _NODE).astype(np.int64)


def _new(keys: np.ndarray) -> np.ndarray:
    return (keys & _ONE).astype(bool)


def _ranks(to: np.ndarray) -> np.ndarray:
    """Place of each row among those of its owner; owners are sorted."""
    if not len(to):
        return to
    first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
    return np.arange(len(to)) - np.repeat(first, np.diff(np.r_[first, len(to)]))


def _best(keys: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest of each owner; a node met before isn't new."""
    keys = np.sort(keys)
    to, node = _to(keys), _node(keys)
    once = np.append(True, (to[1:] != to[:-1]) | (node[1:] != node[:-1]))[: len(keys)]
    keys, to = keys[once], to[once]
    keys = keys[_ranks(to) < k]
    # distances of one pair that hubs rounded unlike aren't next to each other
    pairs = np.sort((_to(keys) << 41) | (_node(keys) << 24) | np.arange(len(keys)))
    again = np.flatnonzero(pairs[1:] >> 24 == pairs[:-1] >> 24) + 1
    return np.delete(keys, pairs[again] & ((1 << 24) - 1)) if len(again) else keys


def _padded(to: np.ndarray, values: np.ndarray, n: int, k: int) -> np.ndarray:
    """The first ``k`` values of each owner as a row, -1 where there are fewer; owners are sorted."""
    out = np.full((n, k), -1, np.int64)
    r = _ranks(to)
    ok = r < k
    out[to[ok], r[ok]] = values[ok]
    return out


def _order(owner: np.ndarray, late: np.ndarray, draw: np.ndarray | int) -> np.ndarray:
    """Rows by owner, those not ``late`` first, then by ``draw`` (under 2 ** 20) and place."""
    keys = (owner << 46) | (late.astype(np.int64) << 45) | (draw << 25) | np.arange(len(owner))
    return np.sort(keys.astype(np.uint64)).astype(np.int64) & ((1 << 25) - 1)


def _blocks(x: np.ndarray, p: Params, rng: np.random.Generator) -> np.ndarray:
    """Neighbours within blocks of nodes that lie next to each other along a random direction."""
    keys = []
    for ids in np.array_split(np.argsort(x @ rng.normal(size=x.shape[1]).astype(x.dtype), kind="stable"), max(1, len(x) // p.block)):
        n = min(p.k, len(ids) - 1)
        y = x[ids] - x[ids].mean(0)
        sq = (y * y).sum(1)
        d = sq[:, None] + sq - 2 * y @ y.T
        np.fill_diagonal(d, np.inf)
        near = np.argpartition(d, n - 1, axis=1)[:, :n]
        keys.append(_coded(np.repeat(ids, n), np.take_along_axis(d, near, 1).ravel(), ids[near].ravel()))
    return np.concatenate(keys)


def graph(x: np.ndarray, p: Params = Params()) -> np.ndarray:
    """Neighbour graph of the rows of ``x`` by NN-descent, as sorted numbers (``_to``, ``_node``).

    A round joins, at each node, its neighbours and those it is a neighbour of (``sample`` of each way, new ones first), so
    every node hears of the neighbours of its neighbours; it keeps the nearest. A node's share of a round is bounded by
    ``sample``, whatever the number of nodes that have it as a neighbour.
    """
    n, rng, keys = len(x), np.random.default_rng(1), np.empty(0, np.uint64)
    if n < 2:
        return keys
    for _ in range(p.directions):
        keys = _best(np.append(keys, _blocks(x, p, rng)), p.k)
    for _ in range(p.rounds):
        to, node, new = _to(keys), _node(keys), _new(keys)
        count = np.bincount(to, minlength=n)
        bits = ((keys >> _D) & np.uint64((1 << 29) - 1)).astype(np.uint32) << np.uint32(2)
        far = np.where(count >= p.k, bits.view(np.float32)[np.cumsum(count) - 1], np.float32(np.inf))
        order = _order(to, ~new, 0)
        forth = _padded(to[order], order, n, p.sample)
        order = _order(node, ~new, rng.integers(0, 1 << 20, len(keys)))
        back = _padded(node[order], order, n, p.sample)
        met = np.concatenate([np.where(forth >= 0, node[forth], -1), np.where(back >= 0, to[back], -1)], 1)
        fresh = np.concatenate([(forth >= 0) & new[forth], (back >= 0) & new[back]], 1)
        # what took part as new is new no more
        for used in (forth, back):
            part = np.zeros(len(keys), bool)
            part[used[used >= 0]] = True
            keys[part] &= ~_ONE
        found, held = [keys], 0
        hubs = np.flatnonzero(fresh.any(1))
        for start in range(0, len(hubs), 512):
            hub = hubs[start : start + 512]
            ids, first = met[hub], fresh[hub]
            # seen from the hub, so that the precision is that of its neighbourhood
            y = x.take(np.maximum(ids, 0), axis=0)
            y -= x[hub][:, None]
            sq = np.einsum("ijk,ijk->ij", y, y)
            sq[ids < 0] = np.inf
            d = np.matmul(y, y.transpose(0, 2, 1))
            d *= -2
            d += sq[:, :, None]
            d += sq[:, None]
            ok = d < far[ids][:, :, None]
            ok &= first[:, :, None] | first[:, None]
            pair = np.flatnonzero(ok)
            row = pair // ids.shape[1]  # of ids as one column
            a, b = ids.ravel()[row], ids.ravel()[row - row % ids.shape[1] + pair % ids.shape[1]]
            other = a != b
            found.append(_coded(a[other], d.ravel()[pair[other]], b[other]))
            held += len(pair)
            if held > 1_000_000:
                found, held = [_best(np.concatenate(found), p.k)], 0
        keys = _best(np.concatenate(found), p.k)
        if _new(keys).sum() < p.settled * len(keys):
            break
    return keys


def _links(keys: np.ndarray, n: int, p: Params) -> np.ndarray:
    """Both directions of a graph's edges, a row for each node, at most ``2 k`` of them drawn at random."""
    both = np.sort(np.append(_to(keys) * n + _node(keys), _node(keys) * n + _to(keys)))
    both = both[np.append(True, both[1:] != both[:-1])[: len(both)]]
    to = both // n
    order = _order(to, np.zeros(len(to), bool), np.random.default_rng(2).integers(0, 1 << 20, len(to)))
    return _padded(to[order], both[order] % n, n, 2 * p.k)


def search(x: np.ndarray, links: np.ndarray, queries: np.ndarray, own: np.ndarray, p: Params = Params()) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Greedy search: numbers of queries and of nodes, for each query the ``beam`` nearest nodes met.

    A query starts at the nearest of some random nodes, at nodes that have the very nearest of these as their nearest (so that it
    gets into groups which only their own members have as neighbours), and at its own node (``own``; -1: elsewhere). Each
    round expands its nearest nodes not yet expanded and keeps the nearest of all met; it ends when all that it keeps are
    expanded. Rounds go over 64 queries at once.
    """
    starts = np.random.default_rng(3).permutation(len(x))[: p.starts]
    at = x[starts]
    sq, all_sq = (np.einsum("ij,ij->i", t, t) for t in (at, x))
    nearest_start = np.concatenate([(sq - 2 * x[i : i + 4096] @ at.T).argmin(1) for i in range(0, len(x), 4096)])
    order = _order(nearest_start, np.zeros(len(x), bool), np.random.default_rng(5).integers(0, 1 << 20, len(x)))
    members = _padded(nearest_start[order], order, len(starts), 32)
    for first in range(0, len(queries), 64):
        q = queries[first : first + 64]
        own_sq = np.einsum("ij,ij->i", q, q)
        seen = np.zeros(len(q) * len(x), bool)
        n = min(p.expand, len(starts))
        far = sq - 2 * q @ at.T
        near = np.argpartition(far, n - 1, axis=1)[:, :n]
        node = np.concatenate([starts[near], members[np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, 1), 1), 1)[:, :8]].reshape(len(q), -1)], 1)
        to, node = np.repeat(np.arange(len(q)), node.shape[1]), node.ravel()
        to, node = to[node >= 0], node[node >= 0]
        home = np.flatnonzero(own[first : first + 64] >= 0)
        to, node = np.append(to, home), np.append(node, own[first : first + 64][home])
        order = np.argsort(to, kind="stable")
        to, node, beam = to[order], node[order], np.empty(0, np.uint64)
        while True:
            # each node once a query
            place = to * len(x) + node
            place = np.sort(place[~seen.take(place)])
            place = place[np.append(True, place[1:] != place[:-1])[: len(place)]]
            seen[place] = True
            to, node = np.divmod(place, len(x))
            d2 = np.empty(len(to), x.dtype)
            ends = np.searchsorted(to, np.arange(len(q) + 1))
            for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
                if b > a:
                    np.matmul(x.take(node[a:b], axis=0), q[i], out=d2[a:b])
            size = all_sq[node] + own_sq[to]
            d2 = size - 2 * d2
            # differences of large squares are taken anew
            close = np.flatnonzero(d2 < 1e-3 * size)
            y = x[node[close]] - q[to[close]]
            d2[close] = np.einsum("ij,ij->i", y, y)
            beam = np.sort(np.append(beam, _coded(to, d2, node)))
            owner = _to(beam)
            ok = _ranks(owner) < p.beam
            beam, owner = beam[ok], owner[ok]
            closed = np.flatnonzero(_new(beam))
            now = closed[_ranks(owner[closed]) < p.expand]
            if not len(now):
                break
            beam[now] &= ~_ONE
            node = links[_node(beam[now])]
            to, node = np.repeat(owner[now], node.shape[1]), node.ravel()
            to, node = to[node >= 0], node[node >= 0]
        yield owner + first, _node(beam)


def _matrix(column: pa.Array, width: int, kind: str) -> np.ndarray:
    """Rows of vectors packed as bytes."""
    if not len(column):
        return np.empty((0, width), kind)
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind).reshape(-1, width)


def _kind(df: DataFrame, vector_col: str) -> str:
    """Floats stay floats, other numbers become doubles."""
    return "<f4" if df.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v`` of the rows that take part, the numbers as bytes: an id, and a vector neither null nor empty nor zero, and
    without null or non-finite components; -0.0 and 0.0 are one number."""
    kind = _kind(df, vector_col)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)))
            flat = column.flatten()
            bad = flat.is_null().to_numpy(zero_copy_only=False)
            values = (pc.fill_null(flat, 0).to_numpy(zero_copy_only=False) + 0).astype(kind)
            many = lambda mask: np.diff(np.append(0, np.cumsum(mask))[ends])
            fine = np.flatnonzero((many(bad | ~np.isfinite(values)) == 0) & (many(values != 0) > 0))
            raw, size = values.tobytes(), values.itemsize
            packed = pa.array([raw[a * size : b * size] for a, b in zip(ends[fine].tolist(), ends[fine + 1].tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(fine)), packed], ["id", "v"])

    e = F.col(vector_col) if kind == "<f4" else F.col(vector_col).cast("array<double>")
    return df.select(F.col(id_col).cast("long").alias("id"), e.alias("e")).where("id IS NOT NULL AND e IS NOT NULL").mapInArrow(pack, "id long, v binary")


def nodes(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int, int, int]:
    """Distinct vectors: ``v``, ``node`` (the least id that has it) and ``n`` (its rows); the dimension, the number of nodes and of rows.

    Vectors whose length isn't the commonest one (of equally common ones the least) take no part, as no distance between
    unlike lengths is defined.
    """
    v = cut(usable(df, id_col, vector_col).groupBy("v").agg(F.min("id").alias("node"), F.count("*").alias("n")), "nodes")
    sizes = v.groupBy(F.length("v").alias("size")).agg(F.sum("n").alias("rows"), F.count("*").alias("nodes")).collect()
    if not sizes:
        return v, 0, 0, 0
    most = min(sizes, key=lambda r: (-r["rows"], r["size"]))
    if len(sizes) > 1:
        path, v = v._evispan_path, v.where(F.length("v") == most["size"])
        v._evispan_path = path
    return v, most["size"] // np.dtype(_kind(df, vector_col)).itemsize, most["nodes"], most["rows"]


@dataclass(frozen=True)
class Cells:
    """``centres`` of the cells and, for each cell, the ``shards`` that hold its nodes."""

    centres: np.ndarray
    shards: list[list[int]]

    def near(self, x: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` cells with the nearest centres, in no order."""
        d = (self.centres * self.centres).sum(1) - 2 * x.astype(np.float64) @ self.centres.T
        return d.argmin(1)[:, None] if n == 1 else np.argpartition(d, n - 1, axis=1)[:, :n]


def cells(v: DataFrame, width: int, kind: str, count: int, p: Params = Params()) -> Cells:
    """Cells of about ``p.rows`` nodes, by k-means over a sample of nodes drawn by hash: 256 a cell, about 65,536 and 16 MB of floats
    at most. The sample places the centres only; every node belongs to the cell with the nearest one. A cell of over one and a half times
    the mean number of nodes gets several shards, dealt by hash.
    """
    rows = min(p.rows, max(1024, p.rows * 64 // width))
    wanted = max(-(-count // rows), min(12, count // 2048))
    if wanted < 2:
        return Cells(np.zeros((1, width)), [list(range(-(-count // rows)))])
    draw = min(256 * wanted, max(1024, 65536 * 64 // max(64, width)))
    scale = 1 << 40
    batch = v.where(F.pmod(F.xxhash64("node"), F.lit(scale)) <= int(scale * min(1, draw / count))).select("node", "v").orderBy("node").toArrow()
    x = _matrix(batch.column("v").combine_chunks(), width, kind).astype(np.float64) if len(batch) else np.zeros((1, width))
    centres = x[np.random.default_rng(4).permutation(len(x))[:wanted]]
    for _ in range(8):
        own = Cells(centres, []).near(x, 1).ravel()
        order = np.argsort(own, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(own[order]) != 0))
        centres = centres.copy()
        centres[own[order][first]] = np.add.reduceat(x[order], first) / np.diff(np.append(first, len(x)))[:, None]
    plain = Cells(centres, [])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(centres), np.int64)
        for batch in batches:
            total += np.bincount(plain.near(_matrix(batch.column(0), width, kind), 1).ravel(), minlength=len(centres))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["cell", "n"])

    told = v.select("v").mapInArrow(tell, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    shards, last = [[] for _ in centres], 0
    for r in told:
        shards[r["cell"]] = list(range(last, last + max(1, round(r["n"] * wanted / count))))
        last += len(shards[r["cell"]])
    return Cells(centres, shards)


def _dealt(v: DataFrame, queries: DataFrame, width: int, kind: str, c: Cells, p: Params) -> DataFrame:
    """``shard, row, node, v``: each node once, in its shard (``row`` 1), each query in the shards of the cells it searches (0)."""
    probes = min(len(c.centres), p.probes + int(p.share * len(c.centres)))
    many = np.array([len(s) for s in c.shards])
    first = np.array([s[0] if s else 0 for s in c.shards])

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = c.near(_matrix(batch.column(1), width, kind), 1).ravel()
            shard = first[cell] + batch.column(2).to_numpy() % many[cell]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(np.ones(len(cell)), pa.int32()), batch.column(0), batch.column(1)], ["shard", "row", "node", "v"])

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                near = c.near(_matrix(part.column(1), width, kind), probes)
                to = [(i, s) for i, own in enumerate(near.tolist()) for cell in own for s in c.shards[cell]]
                if to:
                    at, shard = (np.array(t) for t in zip(*to))
                    yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(np.zeros(len(at)), pa.int32()), part.column(0).take(pa.array(at)), part.column(1).take(pa.array(at))], ["shard", "row", "node", "v"])

    schema = "shard int, row int, node long, v binary"
    mixed = v.select("node", "v", F.pmod(F.xxhash64("node"), F.lit(1 << 31)).alias("draw")).mapInArrow(once, schema)
    return mixed.unionAll(queries.select("node", "v").mapInArrow(often, schema))


def _found(dealt: DataFrame, width: int, kind: str, shards: int, top: int, p: Params) -> DataFrame:
    """``query, node, d``: of each shard's graph the ``top`` nearest nodes that a query's search meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            shard = batch.column(0).to_numpy()
            ends = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True]) if len(shard) else []
            for a, b in zip(ends[:-1], ends[1:]):
                if held and shard[a] != last:
                    yield from within(held)
                    held = []
                last = shard[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from within(held)

    def within(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, node = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (1, 2))
        v = np.concatenate([_matrix(b.column(3), width, kind) for b in held])
        held.clear()
        asked = int((row == 0).sum())
        for start in range(asked, len(row), _MOST) if asked else ():
            yield from answers(node[:asked], v[:asked], node[start : start + _MOST], v[start : start + _MOST])

    def answers(query: np.ndarray, q: np.ndarray, node: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
        middle = v.mean(0, dtype=np.float64)
        size = max(np.abs(v - middle).max(), np.abs(q - middle).max()) or 1
        x, y = (((t - middle) / size).astype(np.float32) for t in (v, q))
        # near ones next to each other, which the memory likes; places of nodes by their number
        along = np.random.default_rng(6).permutation(len(x))[:256]
        sq = np.einsum("ij,ij->i", x[along], x[along])
        order = np.argsort(np.concatenate([(sq - 2 * x[i : i + 4096] @ x[along].T).argmin(1) for i in range(0, len(x), 4096)]), kind="stable")
        x, v, node = x[order], v[order], node[order]
        rank = np.argsort(node)
        at = rank[np.minimum(np.searchsorted(node, query, sorter=rank), len(node) - 1)]
        for a, b in search(x, _links(graph(x, p), len(x), p), y, np.where(node[at] == query, at, -1), p):
            d = np.sqrt(((q[a].astype(np.float64) - v[b].astype(np.float64)) ** 2).sum(1))
            order = np.lexsort((node[b], d, a))
            order = order[_ranks(a[order]) < top]
            yield pa.RecordBatch.from_arrays([pa.array(query[a[order]]), pa.array(node[b[order]]), pa.array(d[order])], ["query", "node", "d"])

    # a task for each shard: numbers that Spark deals to them
    keys = {r["part"]: r["id"] for r in dealt.sparkSession.range(24 * shards + 200).select(F.col("id").cast("int").alias("id")).select("id", F.pmod(F.hash("id"), F.lit(shards)).alias("part")).collect()}
    number = F.get(F.lit([keys.get(i, i) for i in range(shards)]), F.col("shard"))
    return dealt.select(number.alias("shard"), "row", "node", "v").repartition(shards, "shard").sortWithinPartitions("shard", "row", "node").mapInArrow(run, "query long, node long, d double")


def nearest(df: DataFrame, top: int = 10, is_query: Callable[[Column], Column] = lambda c: c % 100 == 0, p: Params = Params(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``top`` nearest rows of each query row, the row itself left out: ``query_id, rank, vec_id, score``.

    ``score`` is the Euclidean distance in double precision, ties go to the smaller id; fewer than ``top`` other rows give
    all. Rows with a null id or an unusable vector (``usable``; other length) take no part. Rows with equal vectors are one node
    of a graph and all of them candidates; rows with one id are one row. Extra columns are not looked at.

    Each node lies in one cell and its shard has one graph; a query searches the graphs of the cells nearest to it.
    """
    spark = df.sparkSession
    v, width, count, rows = nodes(df, id_col, vector_col)
    if not width:
        drop_cut(v)
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    kind = _kind(df, vector_col)
    # most nodes are one row and need no table of owners
    asking = v.where("n = 1").where(is_query(F.col("node")))
    asked = asking.select(F.col("node").alias("query_id"), F.col("node").alias("query"))
    owner = None
    if rows > count:
        shared = v.where("n > 1")
        owner = cut(usable(df, id_col, vector_col).join(shared.select("v", "node"), "v").select("id", "node").distinct(), "owner")
        more = owner.where(is_query(F.col("id"))).select(F.col("id").alias("query_id"), F.col("node").alias("query"))
        asked = asked.unionAll(more)
        asking = asking.unionAll(shared.join(more.select(F.col("query").alias("node")).distinct(), "node", "left_semi").select(v.columns))
    p = replace(p, beam=max(p.beam, 2 * (top + 1)))
    c = cells(v, width, kind, count, p)
    found = _found(_dealt(v, asking, width, kind, c, p), width, kind, sum(map(len, c.shards)), top + 1, p)
    close = found.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("d", "node"))).where(F.col("r") <= top + 1).select("query", "node", "d")
    hits = close.select("query", F.col("node").alias("vec_id"), F.col("d").alias("score"))
    if owner is not None:
        # of rows with one vector only the first few can be among the nearest
        firsts = owner.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("id"))).where(F.col("r") <= top + 1).select("node", "id")
        # rows of one vector ask the same; each asks once for a node, so rows stay at (top + 1) squared a query
        each = close.join(firsts, "node", "left").select("query", F.coalesce("id", "node").alias("vec_id"), F.col("d").alias("score"))
        hits = each.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))).where(F.col("r") <= top + 1).drop("r")
    out = asked.join(hits, "query").where("query_id <> vec_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).cast("int")).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
    out = cut(out, "nearest")
    drop_cut(v, *([] if owner is None else [owner]))
    return out
