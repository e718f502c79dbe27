"""Removal of passages that occur before, by interval expansion on a Burrows-Wheeler transform."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evispan.llm._anchors import anchors
from evispan.llm._common import cut, drop_cut, parts, slices

#: Bytes of an anchor, of the windows' 100. Bytes of context that one transform is built over.
WIDTH, BATCH = 32, 1_500_000


def bounded_bwt(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order by the first ``depth`` bytes (``depth`` >= 8; ties in any order) and the byte before each suffix.

    ``data`` must end in a zero byte, which also counts as the byte before the first suffix: then suffixes that begin with
    a byte are as many as suffixes it stands before, as the transform's counting needs. Ranks of 8 bytes are packed into one number; ranks of longer stretches come from two shorter ones. Past the
    end come zeros, so a stretch that reaches the end must not be compared.
    """
    n = len(data)
    key, wide = np.zeros(n, np.uint64), np.append(data, np.zeros(8, data.dtype)).astype(np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | wide[i : i + n]
    done, order, rank = 8, None, None
    while True:
        order = np.argsort(key, kind="stable")
        step = np.append(False, key[order[1:]] != key[order[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        if done == depth:
            return order, np.where(order > 0, data[order - 1], 0).astype(np.int64)
        shift = min(done, depth - done)
        later = np.append(rank[shift:], np.zeros(min(shift, n), np.int64))[:n]
        key = (rank * (n + 1) + later).astype(np.uint64)
        done += shift


def short_prefixes(bwt: np.ndarray, least: int) -> np.ndarray:
    """Places whose suffix has fewer than ``least`` bytes in common with the one before it in order.

    Breadth first: the interval of the empty string is all; extending the string w of an interval by a byte c to
    the left gives the interval of cw, whose right border is new exactly if the suffixes on its two sides agree on
    |w| bytes and no more. So borders come by increasing common prefix; a border found again ends its branch, and
    expansion stops at ``least``, longer prefixes never being worked out.
    """
    n = len(bwt)
    by_byte = np.argsort(bwt, kind="stable")  # place of the suffix one byte longer: its inverse
    to = np.empty(n, np.int64)
    to[by_byte] = np.arange(n)
    following = np.full(n, n, np.int64)  # next place with the same byte
    same = bwt[by_byte[1:]] == bwt[by_byte[:-1]]
    following[by_byte[:-1][same]] = by_byte[1:][same]
    border = np.zeros(n + 1, bool)
    border[0] = border[n] = True
    left, right = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for _ in range(least):
        size = right - left
        ends = np.cumsum(size)
        place = np.repeat(left - ends + size, size) + np.arange(ends[-1])
        last = following[place] >= np.repeat(right, size)  # of its byte in its interval
        new = to[place[last]] + 1
        new = np.unique(new[~border[new]])
        if not len(new):
            break
        border[new] = True
        known = np.flatnonzero(border)
        left, right = known[np.searchsorted(known, new) - 1], new
    return border[:n]


def repeated_windows(contexts: list[bytes], order: np.ndarray, length: int) -> list[np.ndarray]:
    """For each context, the places in it whose ``length`` bytes also begin, earlier in ``order``, in another one.

    ``order``: for every byte of all contexts, joined by a zero byte behind each, its place in the order of documents.
    """
    data = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
    lens = np.array([len(c) for c in contexts])
    start = np.cumsum(lens + 1) - lens - 1
    window = np.zeros(len(data), bool)
    for a, n in zip(start.tolist(), lens.tolist()):
        window[a : a + n - length + 1] = True
    suffixes, bwt = bounded_bwt(data, length)
    group = np.cumsum(short_prefixes(bwt, length))
    keep = window[suffixes]
    suffixes, group = suffixes[keep], group[keep]
    by = np.lexsort((order[suffixes], group))
    suffixes, group = suffixes[by], group[by]
    again = np.sort(suffixes[np.append(False, group[1:] == group[:-1])])
    edges = np.searchsorted(again, np.append(start, len(data)))
    return [again[a:b] - s for a, b, s in zip(edges, edges[1:], start)]


def _runs(places: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Stretches covered by the windows at sorted places."""
    if not len(places):
        return []
    gap = np.flatnonzero(np.diff(places) > length)
    return list(zip(places[np.append(0, gap + 1)].tolist(), (places[np.append(gap, len(places) - 1)] + length).tolist()))


def _keyed(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """``k1`` (the id; null: the least number), ``k2`` (a hash of the text) and the text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("k1"), F.xxhash64(text).alias("k2"), text.alias("text"), *more)


_MARKS = "k1 long, k2 long, start long, end long"


#: Occurrences from which on an anchor's contexts are dealt to tasks by wider anchors.
HOT = 1000

#: Contexts of an anchor: (place of the anchor in the bytes, bytes) -> first place (k1, k2, start).
Contexts = dict[tuple[int, bytes], tuple[int, int, int]]


def settle(own: Contexts, off: int, ctx: bytes, place: tuple[int, int, int]) -> tuple | None:
    """Add an occurrence of a context; of two, the later is repeated as a whole and returned with its end."""
    before = own.setdefault((off, ctx), place)
    if before == place:  # new, or a repeated row met itself
        return None
    own[off, ctx], late = (before, place) if before <= place else (place, before)
    return (*late, late[2] + len(ctx))


def narrowed(ctx: bytes, off: int, start: int, width: int, length: int) -> Iterator[tuple[bytes, bytes, int, int, int]]:
    """The windows of a context, dealt to wider anchors: (what the anchor grew by, bytes, place of the wider anchor, start, width).

    A window holds the anchor and ``length - width`` bytes more, of which half or more lie before it, or else over half
    behind it. So each window belongs to the anchor with that stretch on the one side, by its content alone.
    """
    before = -(-(length - width) // 2)
    last = min(off - before, len(ctx) - length)  # last window with so many bytes before the anchor
    if last >= 0:
        yield b"<" + ctx[off - before : off], ctx[: last + length], off - before, start, width + before
    behind, first = length - width - before + 1, max(0, off - before + 1)
    if first <= len(ctx) - length:
        yield b">" + ctx[off + width : off + width + behind], ctx[first:], off - first, start + first, width + behind


def groups_of(own: Contexts, width: int, length: int, most: int, marks: list[tuple]) -> Iterator[Contexts]:
    """Groups of an anchor's contexts that may have windows in common, each of ``most`` bytes or fewer.
    The anchor is widened once, and again while the group is too large; who is alone with a wider one leaves. What is found
    repeated as a whole goes to ``marks``."""
    by: dict[tuple[int, bytes], Contexts] = {}
    for (off, ctx), (k1, k2, start) in own.items():
        for grown, sub, at, a, wide in narrowed(ctx, off, start, width, length):
            if late := settle(by.setdefault((wide, grown), {}), at, sub, (k1, k2, a)):
                marks.append(late)
    for (wide, _), group in by.items():
        if len(group) > 1:  # never where the anchor is the window: all are equal then
            if sum(len(ctx) for _, ctx in group) > most:
                yield from groups_of(group, wide, length, most, marks)
            else:
                yield group


def _wider(h: int, grown: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(grown, digest_size=8, key=h.to_bytes(8, "little", signed=True)).digest(), "little", signed=True)


def repeated_spans(df: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stretches of bytes covered by a ``length``-byte string that also starts earlier: ``k1, k2, start, end`` (see
    ``_keyed``); stretches of a document may overlap.

    1. Each window of ``length`` bytes has an anchor, picked by content (``_anchors``), so equal windows have equal anchors.
       Anchors in one document only and once there are dropped by a count (a row a task and anchor) and a semi join.
    2. Every other anchor's occurrence gives a context, the bytes of its windows. Equal contexts leave the first; the others
       are repeated as a whole. This is done in each task before the shuffle, so a passage in very many
       documents reaches the shuffle once a task. Contexts of a frequent anchor (``HOT``) are dealt by wider anchors, so a common line
       with unlike neighbours spreads over tasks.
    3. Where an anchor has several contexts, the anchor is widened to one side or the other, by which most contexts that only
       share a phrase leave. The others go, with those of other anchors, into a Burrows-Wheeler transform, and
       interval expansion up to ``length`` gives the groups of equal windows; all but the first of each are repeated.

    Sums of sizes: texts are shuffled once, contexts once. Nothing is collected; a task holds its share of contexts.
    """
    spark = df.sparkSession
    keyed = _keyed(df, id_col, text_col).where(F.octet_length("text") >= length)

    def of(text: str):
        raw = text.encode()
        return raw, *anchors(np.frombuffer(raw, np.uint8), WIDTH, length)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

        for _, own in slices(batches):
            for text in own:
                held.append(of(text)[1])
                size += len(held[-1])
            if size > 2_000_000:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, own in slices(batches):
            h = [np.unique(of(t)[1]) for t in own]
            n = [len(x) for x in h]
            key = lambda i: pa.array(np.repeat(batch.column(i).to_numpy(), n))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h).view(np.int64)), key(0), key(1)], ["h", "k1", "k2"])

    repeated = cut(keyed.select("text").mapInArrow(counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h", (F.col("n") >= HOT).alias("hot")), "anchors")
    found = keyed.mapInArrow(occurrences, "h long, k1 long, k2 long").join(repeated, "h")
    # a document's own anchors, and those of them that are frequent
    lists = cut(found.groupBy("k1", "k2").agg(F.collect_list("h").alias("hs"), F.collect_list(F.when(F.col("hot"), F.col("h"))).alias("hot")), "found")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, own in slices(batches, most=4_000_000):
            k1, k2 = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            wanted, frequent = batch.column(3), batch.column(4)
            first: dict[tuple[int, int], Contexts] = {}
            marks: dict[tuple[int, int], list] = {}
            for i in range(len(own)):
                raw, h, at, lo, hi = of(own[i])
                own_h = h.view(np.int64)
                use = np.flatnonzero(np.isin(own_h, wanted[i].values.to_numpy()))
                hot = np.isin(own_h[use], frequent[i].values.to_numpy())
                for h, a, b, c, often in zip(own_h[use].tolist(), at[use].tolist(), lo[use].tolist(), hi[use].tolist(), hot.tolist()):
                    ctx = raw[b : c + length]
                    for group, sub, off, start, wide in ((_wider(h, x[0]), *x[1:]) for x in narrowed(ctx, a - b, b, WIDTH, length)) if often else ((h, ctx, a - b, b, WIDTH),):
                        if late := settle(first.setdefault((group, wide), {}), off, sub, (k1[i], k2[i], start)):
                            marks.setdefault(late[:2], []).append(late[2:])
            rows = [(h, *place, None, off, wide, ctx) for (h, wide), found in first.items() for (off, ctx), place in found.items()]
            for (a, b), spans in marks.items():
                rows += [(b, a, b, s, e, None, None, None) for s, e in merge(spans)]
            yield _rows(rows)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 8, kinds)], ["h", "k1", "k2", "start", "end", "off", "wide", "ctx"])

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[int, int], Contexts] = {}
        marks: list[tuple] = []

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*marks)) or [()] * 4], ["k1", "k2", "start", "end"])
            marks.clear()
            return got

        for batch in batches:
            for h, k1, k2, start, end, off, wide, ctx in zip(*(batch.column(i).to_pylist() for i in range(8))):
                if ctx is None:
                    marks.append((k1, k2, start, end))
                elif late := settle(groups.setdefault((h, wide), {}), off, ctx, (k1, k2, start)):
                    marks.append(late)
            if len(marks) > 200_000:
                yield out()
        pending: list[tuple] = []
        size = 0
        for (_, wide), own in groups.items():
            if len(own) < 2:
                continue
            for group in groups_of(own, wide, length, BATCH, marks):
                pending += [(ctx, place) for (_, ctx), place in group.items()]
                size += sum(len(ctx) + 1 for _, ctx in group)
                if size > BATCH:
                    marks += _again(pending, length)
                    pending, size = [], 0
                    yield out()
        if pending:
            marks += _again(pending, length)
        yield out()

    rows = keyed.join(lists, ["k1", "k2"]).select("k1", "k2", "text", "hs", "hot").mapInArrow(contexts, "h long, k1 long, k2 long, start long, end long, off long, wide long, ctx binary")
    marks = cut(rows.repartition(parts(spark), "h").mapInArrow(resolve, _MARKS), "spans")
    drop_cut(repeated, lists)
    return marks


def _again(pending: list[tuple], length: int) -> list[tuple]:
    """Repeated stretches of the contexts of several anchors."""
    ctxs, places = [c for c, _ in pending], [p for _, p in pending]
    size = np.array([len(c) + 1 for c in ctxs])
    docs: dict[tuple, int] = {}
    for p in sorted({p[:2] for p in places}):
        docs[p] = len(docs)
    base = np.array([docs[p[:2]] for p in places], np.int64) << 32
    at = np.array([p[2] for p in places], np.int64)
    ends = np.cumsum(size)
    order = np.repeat(base + at - ends + size, size) + np.arange(ends[-1])
    return [(*p[:2], p[2] + a, p[2] + b) for p, found in zip(places, repeated_windows(ctxs, order, length)) for a, b in _runs(found, length)]


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of stretches; touching ones become one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def dedup(df: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", as_text: bool = False) -> DataFrame:
    """What is left of each document: ``rest`` (all columns of ``df`` but the text), ``n_bytes, n_removed, n_spans, kept``.

    ``kept`` has the remaining bytes, joined; with ``as_text`` as a string, without the parts of characters that a removal cut. Texts count as UTF-8 bytes, a null text as empty. Earlier: smaller id (an
    integer; null before all), then, under one id, smaller hash of the text, then earlier start. Rows repeated with id and
    text are one document and all get its result. Texts under ``length`` bytes stay whole. An empty table
    gives none; other columns are only handed on.
    """
    marks = repeated_spans(df, length, id_col, text_col)
    spans = marks.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    key = _keyed(df.select(F.col(id_col), F.col(text_col), F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text_col]).alias("_rest")), id_col, text_col, "_rest")
    rows = key.withColumnRenamed("_rest", "rest")
    rest = rows.schema["rest"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, own in slices(batches, most=4_000_000):
            out: list[list] = [[], [], [], []]
            for text, found in zip(own, batch.column(1).to_pylist()):
                raw = text.encode()
                gone = merge([(s["start"], s["end"]) for s in found or ()])
                edges = [0, *(x for span in gone for x in span), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                for column, x in zip(out, (len(raw), len(raw) - len(kept), len(gone), kept)):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(2), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array([x.decode("utf-8", "ignore") for x in out[3]], pa.string()) if as_text else pa.array(out[3], pa.binary())], ["rest", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.join(spans, ["k1", "k2"], "left").select("text", "spans", "rest").mapInArrow(work, f"rest {rest}, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}")


def digests(df: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of ``dedup``."""
    out = dedup(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), length)
    return out.select("rest.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
