"""Near-duplicate detection: BagMinHash signatures, bands, verified overlap of shingle multisets, components."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evispan.llm._common import cut, drop_cut, parts, slices

_WORD = re.compile(r"\w+")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_NONE = -(2**63)


@dataclass(frozen=True)
class Params:
    """``words`` a shingle; two texts are near when their multisets' weighted Jaccard is ``least`` or more; ``bands`` of
    ``rows`` signature values each. A pair at ``least`` is missed with probability (1 - least**rows)**bands: 5e-8.

    ``doubt``: members of a bucket are compared only if their signatures agree in as many places as a pair at ``least`` does but for
    this probability. ``block`` members, or ``weight`` shingles, of a bucket are compared in one piece; memory only."""

    words: int = 5
    least: float = 0.8
    bands: int = 32
    rows: int = 4
    doubt: float = 1e-9
    block: int = 4096
    weight: int = 700_000

    def agreeing(self) -> int:
        """Places in which signatures must agree: the most of which a pair at ``least`` has fewer with probability ``doubt``."""
        n, below = self.bands * self.rows, 0.0
        for places in range(n + 1):
            below += math.comb(n, places) * self.least**places * (1 - self.least) ** (n - places)
            if below > self.doubt:
                return places
        return n


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _times(i: int) -> np.uint64:
    return np.uint64(int(_STEP) * i & 0xFFFFFFFFFFFFFFFF)


class Shingler:
    """Multiset of word shingles as 64-bit hashes. Words are those of the lower-case text; fewer than a shingle's are one."""

    def __init__(self, words: int):
        self.words, self.memo = words, {}

    def word(self, w: str) -> int:
        h = 0xCBF29CE484222325
        for b in w.encode():
            h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
        return h

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct hashes and how often each occurs."""
        if len(self.memo) > 200_000:
            self.memo.clear()
        memo, found = self.memo, []
        for u in text.lower().split():
            if (h := memo.get(u)) is None:
                h = memo[u] = [self.word(w) for w in ([u] if u.isalnum() else _WORD.findall(u))]
            found += h
        n = len(found)
        if not n:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        w = mix(np.array(found, np.uint64))
        k = min(self.words, n)
        out = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            out = mix(out * np.uint64(0x100000001B3) + w[i : n - k + 1 + i])
        return np.unique(out, return_counts=True)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int) -> np.ndarray:
    """BagMinHash: a row of ``m`` values for each bag; two bags agree in a place with probability their weighted Jaccard.

    Weights are counts, cut at 0, 1, 2, 4, 8, ...: each level [a, 2a) of an element is a Poisson process of rate a, made from
    the element's hash alone, whose points carry a time, a place in the signature and a height in the level. A level
    that the count reaches into in part takes the points below the count, which is where halving the level again
    and again would end. A place keeps its earliest point. Points come by time, so a process ends as soon as its
    next point is later than all places of its bag.
    """
    sig = np.full((len(bags), m), np.inf)
    live = [i for i, (h, _) in enumerate(bags) if len(h)]
    if not live:
        return sig
    bag = np.repeat(live, [len(bags[i][0]) for i in live])
    element, count = np.concatenate([bags[i][0] for i in live]), np.concatenate([bags[i][1] for i in live])
    all_ = [[], [], [], []]  # bag, seed, rate, share of the level that counts
    low, level = 0, 0
    while len(bag):
        size = max(1, low)
        for column, x in zip(all_, (bag, mix(mix(element) + _times(2 * level + 1)), np.full(len(bag), float(size)), np.minimum(1.0, (count - low) / size))):
            column.append(x)
        low, level = low + size, level + 1
        more = count > low
        bag, element, count = bag[more], element[more], count[more]
    bag, seed, rate, share = map(np.concatenate, all_)
    time, flat, i = np.zeros(len(bag)), sig.reshape(-1), 0
    while len(bag):
        i += 1
        a = mix(seed + _times(i))
        b = mix(a ^ _STEP)
        time = time - np.log1p(-(a >> np.uint64(11)).astype(float) * 2.0**-53) / rate
        on = ((b >> np.uint64(32)).astype(float) * 2.0**-32) < share
        np.minimum.at(flat, bag[on] * m + (b[on] & np.uint64(0xFFFFFFFF)).astype(np.int64) % m, time[on])
        keep = time < sig.max(1)[bag]
        bag, seed, rate, share, time = bag[keep], seed[keep], rate[keep], share[keep], time[keep]
    return sig


def band_keys(sig: np.ndarray, p: Params) -> np.ndarray:
    """A 64-bit key for each bag and band."""
    bits = sig.view(np.uint64).reshape(len(sig), p.bands, p.rows)
    key = np.repeat(mix(np.arange(1, p.bands + 1, dtype=np.uint64))[None], len(sig), 0)
    for i in range(p.rows):
        key = mix(key * np.uint64(0x100000001B3) + bits[:, :, i])
    return key


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two multisets of sorted hashes; 1 for two empty ones."""
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 1.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (total - both)


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The id as ``k`` (null: the least number), the text's digest as ``t`` and the text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE)).alias("k"), F.unhex(F.md5(text.cast("binary"))).alias("t"), text.alias("text"))


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """Connected components of links ``a, b``: ``node, label``, the least node of each; a node linked to itself alone isn't listed.

    Rounds: each node points to its least neighbour or itself, pointers are followed twice, and links are drawn anew
    between what they lead to, without those that have become one. So links go down fast, and rounds are about the logarithm of the
    longest path. A round's pointers and links are written tables."""
    links = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tag)
    both, now = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))), None
    while True:
        near = cut(links.select(F.inline(both).alias("a", "b")).groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), tag)
        step = cut(near.join(near.select(F.col("node").alias("label"), F.col("label").alias("far")), "label").select("node", F.col("far").alias("label")), tag)
        to = lambda c: step.select(F.col("node").alias(c), F.col("label").alias(f"{c}_to"))
        left = links.join(to("a"), "a").join(to("b"), "b").where("a_to <> b_to").select(F.greatest("a_to", "b_to").alias("a"), F.least("a_to", "b_to").alias("b")).distinct()
        left = cut(left, tag)
        drop_cut(links, near)
        links = left
        if now is None:
            now = step
        else:
            later = cut(now.join(step.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label")), tag)
            drop_cut(now, step)
            now = later
        if not links.limit(1).count():
            drop_cut(links)
            return now


def _verified(pairs: DataFrame, bags: DataFrame, p: Params) -> DataFrame:
    """Of pairs ``a, b`` those near by their multisets. A bag goes to its pairs; the join splits a pair's hot side."""
    left = bags.select(F.col("k").alias("a"), F.col("hs").alias("ha"), F.col("ns").alias("na"))
    right = bags.select(F.col("k").alias("b"), F.col("hs").alias("hb"), F.col("ns").alias("nb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)) for c in ("ha", "na", "hb", "nb")]
            keep = []
            for i in range(batch.num_rows):
                ha, na, hb, nb = (c[i].values.to_numpy(zero_copy_only=False) for c in cols)
                keep.append(overlap((ha.view(np.uint64), na), (hb.view(np.uint64), nb)) >= p.least)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in ("a", "b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(right, "b").join(left, "a").select("a", "b", "ha", "na", "hb", "nb").mapInArrow(run, "a long, b long")


def _relabel(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members ``bucket, k, label`` under new labels of the old ones."""
    return members.join(labels.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("bucket", "k", F.coalesce("to", "label").alias("label"))


def _open(members: DataFrame) -> DataFrame:
    """Members of buckets in which more than one label is left."""
    return members.join(members.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("bucket"), "bucket")


def _blocks(members: DataFrame, size: str, most: int, *more: str) -> DataFrame:
    """Members ``bucket, k`` dealt by a hash to blocks of about ``most`` in sum of ``size``, once for each block that theirs
    meets: ``bucket, i, j, own, k`` and ``more``, sorted in partitions. A bucket of one block is dealt once."""
    sums = members.groupBy("bucket").agg(F.ceil(F.sum(size) / most).cast("int").alias("blocks"))
    own = members.join(sums, "bucket").withColumn("own", F.pmod(F.xxhash64("k", F.lit(7)), F.col("blocks")).cast("int"))
    one = own.where("blocks = 1").select("bucket", F.lit(0).alias("i"), F.lit(0).alias("j"), "own", "k", *more)
    many = own.where("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "k", *more)
    return one.unionAll(many).repartition(parts(members.sparkSession), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "k")


def _candidates(members: DataFrame, p: Params) -> DataFrame:
    """Links ``a, b`` that join, in each bucket, those members ``bucket, k, label, sig`` of unlike label whose signatures agree in
    enough places; a bucket gives fewer links than it has members."""
    least, width = p.agreeing(), p.bands * p.rows

    def flush(rows: list[tuple]) -> list[tuple[int, int]]:
        if len(rows) < 2:
            return []
        own, k, label = (np.array([r[c] for r in rows]) for c in range(3))
        sig = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(-1, width)
        two, root = own.min() != own.max(), np.arange(len(rows))
        for x in range(1, len(rows)):
            other = np.flatnonzero((label[:x] != label[x]) & ((own[:x] != own[x]) | (not two)))
            near = other[(sig[other] == sig[x]).sum(1) >= least]
            if len(near):
                root[np.isin(root, root[near])] = root[x]
        # to the least of each group, which other buckets are likely to have as well
        order = np.lexsort((k, root))
        first = np.flatnonzero(np.append(True, root[order[1:]] != root[order[:-1]]))
        least_k = np.repeat(k[order[first]], np.diff(np.append(first, len(order))))
        return [(a, b) for a, b in zip(k[order].tolist(), least_k.tolist()) if a != b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for bucket, i, j, own, k, label, sig in zip(*(batch.column(c).to_pylist() for c in range(7))):
                if (bucket, i, j) != at:
                    out += flush(rows)
                    at, rows = (bucket, i, j), []
                rows.append((own, k, label, sig))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in (0, 1)], ["a", "b"])
        out = flush(rows)
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in (0, 1)], ["a", "b"])

    return _blocks(members.withColumn("one", F.lit(1)), "one", p.block, "label", "sig").mapInArrow(run, "a long, b long")


def _compare(members: DataFrame, bags: DataFrame, p: Params) -> DataFrame:
    """Links between members ``bucket, k, label`` of unlike label of each bucket, every two compared but those linked already.

    A bucket falls into blocks by a hash of the member; a task compares one block with another (or itself), so it
    holds two blocks however large the bucket is. It gives only links that join what it has not joined yet."""

    def flush(rows: list[tuple]) -> list[tuple[int, int]]:
        if len(rows) < 2:
            return []
        block, label = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
        n = np.concatenate([r[3][1] for r in rows])
        ends = np.cumsum([0, *(len(r[3][0]) for r in rows)])
        kinds, at = np.unique(np.concatenate([r[3][0] for r in rows]), return_inverse=True)
        before = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])[ends]
        weight, two = np.diff(before), block.min() != block.max()
        own, root, links = np.zeros(len(kinds), n.dtype), label.copy(), []
        for x in range(1, len(rows)):
            # members of one block meet in the pair of that block with itself
            w = weight[:x]
            open_ = (root[:x] != root[x]) & (np.minimum(w, weight[x]) >= p.least * np.maximum(w, weight[x])) & ((block[:x] != block[x]) | (not two))
            if not open_.any():
                continue
            mine = slice(ends[x], ends[x + 1])
            own[at[mine]] = n[mine]  # overlaps of x with all before it, in one pass over them
            upto = np.concatenate([[0], np.cumsum(np.minimum(own[at[: ends[x]]], n[: ends[x]]), dtype=np.int64)])
            own[at[mine]] = 0
            both = np.diff(upto[ends[: x + 1]])
            union = w + weight[x] - both
            near = (union == 0) | (both / np.maximum(union, 1) >= p.least)
            for y in np.flatnonzero(open_ & near):
                if root[x] != root[y]:
                    root[root == root[y]] = root[x]
                    links.append((int(label[x]), int(label[y])))
        return links

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for batch in batches:
            out: list[tuple[int, int]] = []
            hs, ns = batch.column(6), batch.column(7)
            for n, (bucket, i, j, own, k, label) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(6)))):
                if (bucket, i, j) != at:
                    out += flush(rows)
                    at, rows = (bucket, i, j), []
                rows.append((own, k, label, (hs[n].values.to_numpy(zero_copy_only=False).copy().view(np.uint64), ns[n].values.to_numpy(zero_copy_only=False).copy())))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in (0, 1)], ["a", "b"])
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in flush(rows)], pa.int64()) for c in (0, 1)], ["a", "b"])

    heavy = members.join(bags, "k").withColumn("size", F.size("hs"))
    return _blocks(heavy, "size", p.weight, "label", "hs", "ns").mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Class of each document: ``doc_id, text_id, class_id``.

    ``text_id`` is the least id with the very same text, ``class_id`` the least id reached over links; a link joins two
    texts that share a band and whose shingle multisets overlap by ``Params.least``. Ids are integers; a null id counts as the
    least number and so may represent a class, as null. Null texts count as empty; texts without words are near each
    other. Rows with one id are one node. An empty table gives none; other columns are not looked at.

    Equal texts are one row from the signatures on. A bucket's members are first compared with one of them, so a
    group of copies costs a pair a member, never all pairs. Where more than one component is left, members whose signatures are
    near over component borders (``Params.doubt``) form clusters over all buckets; each cluster is compared block by
    block, so each multiset goes there once, however many buckets it is in, and no link within a bucket is lost.
    Buckets with equal members count once. Links and labels stay in written tables.
    """
    out = _classes(df, p, id_col, text_col)
    return out.select(*[F.nullif(F.col(c), F.lit(_NONE)).alias(n) for c, n in (("k", "doc_id"), ("text_k", "text_id"), ("label", "class_id"))])


def _classes(df: DataFrame, p: Params, id_col: str, text_col: str) -> DataFrame:
    """``k, t, text_k, label`` of each row, as a written table."""
    keyed = _keyed(df, id_col, text_col)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bag = Shingler(p.words)
        for batch, own in slices(batches):
            sig = signatures([bag(t) for t in own], p.bands * p.rows)
            keys = band_keys(sig, p)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, p.bands), pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
            short = mix(sig.view(np.uint64)).astype(np.uint8)  # a byte a place is enough to tell far from near
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flat, pa.array([x.tobytes() for x in short], pa.binary())], ["k", "t", "keys", "sig"])

    signed = cut(keyed.mapInArrow(sign, "k long, t binary, keys array<long>, sig binary"), "signed")
    same = cut(signed.groupBy("t").agg(F.min("k").alias("text_k"), F.first("keys").alias("keys"), F.first("sig").alias("sig")), "texts")
    rows = same.select(F.col("text_k").alias("k"), F.explode("keys").alias("key"))
    # what tells a bucket's members: their number, least and mixed hash; one of the buckets with equal members stays
    kinds = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("k").alias("least"), F.bit_xor(F.xxhash64("k")).alias("mixed")).where("n > 1")
    chosen = kinds.groupBy("n", "least", "mixed").agg(F.min("key").alias("key"))
    members = cut(rows.join(chosen.select("key", F.col("least").alias("pivot")), "key").select(F.col("key").alias("bucket"), "k", "pivot"), "members")

    wanted = members.select("k").distinct().join(same.select(F.col("text_k").alias("k"), "t"), "k")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bag = Shingler(p.words)
        for batch, own in slices(batches):
            bags = [bag(t) for t in own]
            ends = pa.array(np.cumsum([0, *(len(h) for h, _ in bags)]), pa.int32())
            values = [np.concatenate([x[i] for x in bags]) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(values[0].view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(values[1].astype(np.int32)))], ["k", "hs", "ns"])

    # the text of one row an id: of rows with one id and unlike texts, the one whose text_k it is
    first = keyed.join(wanted, ["k", "t"], "left_semi").select("k", "text")
    bags = cut(first.mapInArrow(count, "k long, hs array<long>, ns array<int>"), "bags")

    links = [cut(_verified(members.where("k <> pivot").select(F.col("pivot").alias("a"), F.col("k").alias("b")).distinct(), bags, p), "links")]
    labels = [components(links[0])]
    now = _open(_relabel(members.select("bucket", "k", F.col("k").alias("label")), labels[0]))
    clusters = components(_candidates(now.join(same.select(F.col("text_k").alias("k"), "sig"), "k").select("bucket", "k", "label", "sig"), p))
    if clusters.limit(1).count():
        own = _relabel(clusters.select(F.col("label").alias("bucket"), F.col("node").alias("k"), F.col("node").alias("label")), labels[0])
        labels.append(components(_compare(own, bags, p)))
    # class of each distinct text: labels of labels, then over all rows
    out = same.select("t", "text_k", F.col("text_k").alias("label"))
    for x in labels:
        out = out.join(x.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("t", "text_k", F.coalesce("to", "label").alias("label"))
    result = cut(signed.select("k", "t").join(out, "t").select("k", "t", "text_k", "label"), "classes")
    drop_cut(signed, members, clusters, *links, *labels, same, bags)
    return result


def keep_one(df: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, all columns: the one with the least id (of rows with that id, the least in order of digest)."""
    classes = _classes(df, p, id_col, text_col)
    # the class's least id may belong to rows of unlike text; min by (id, digest) names one text
    kept = classes.groupBy("label").agg(F.min(F.struct("k", "t")).alias("x")).select("x.k", "x.t")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keys = {"k": F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE)), "t": F.unhex(F.md5(text.cast("binary")))}
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(n) for n, c in keys.items()]).join(kept, ["k", "t"], "left_semi")
    if classes.groupBy("k", "t").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        rows = rows.dropDuplicates(["k", "t"])  # rows repeated as a whole, rare enough to pay for only when there
    return rows.select("row.*")
