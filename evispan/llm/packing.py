"""Best-fit packing of tokenised documents into sequences, in bulk-synchronous rounds."""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from evispan.llm._common import cut, drop_cut, slices, texts

#: Units that a worker's table may hold before it is emptied: memory only, never a result.
MEMO = 700_000
#: Words that the library gets as one text.
JOINED = 4000
#: The last letter up to which lower-case letters are surely in normal form and letters for both sides.
_PLAIN = "\u024f"
#: Items and gaps that one range of a round has, about.
RANGE = 100_000
#: Separators that Python's split() takes for white space and the tokenizer doesn't.
_CONTROL = re.compile("[\x1c-\x1f]")
#: Letters and the signs behind them, none of which the splitter takes to the letters.
_SIGNS = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)")


class _Numbers(dict):
    """Number of each unit, in order of appearance."""

    def __missing__(self, unit: str) -> int:
        n = self[unit] = len(self)
        return n


class WordEncoder:
    """Ids of whole texts by the ``tokenizers`` library, word by word.

    The file's normaliser (NFC, lower case) and splitter drop white space and never join across it, so a part between white
    space (a unit) always has the same ids; each is encoded by the library once, or put together from its letters' and its
    signs', and kept in a flat table, from which a text's ids are gathered. Texts with special tokens, or with
    characters that the two sides may see differently, go to the library whole.
    """

    def __init__(self, path: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for tok in (self.tok, self.bare):
            tok.no_truncation()
            tok.no_padding()
        # for words of lower-case letters, that the normaliser leaves alone and the splitter takes whole
        self.bare.normalizer = None
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        ids = self.tok.get_vocab(with_added_tokens=True)
        self.ending = np.zeros(max(ids.values()) + 1, bool)
        self.ending[[i for t, i in ids.items() if t.endswith("</w>")]] = True
        self.end = end
        self.forget()

    def forget(self) -> None:
        """Empty the table but for its first unit, the end of a text."""
        self.number = _Numbers({"": 0})
        self.flat, self.start, self.size = np.array([self.end], np.uint32), np.zeros(1, np.int64), np.ones(1, np.int64)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, known: int) -> None:
        """Add the units numbered from ``known`` on to the table: words of common letters, many as one text, cut behind each id
        that ends a word; others singly; letters with signs from both."""
        get, both = self.number.__getitem__, []
        for n, u in enumerate(list(islice(self.number, known, None)), known):
            if not u.isalpha() and (m := _SIGNS.fullmatch(u)) and m[1].isalpha():
                both.append((n, get(m[1]), get(m[2])))
        units = list(islice(self.number, known, None))
        kind = np.array([u.isalpha() and max(u) <= _PLAIN for u in units], np.int8)
        made = np.array(both, np.int64).reshape(-1, 3)
        kind[made[:, 0] - known] = 2
        flat, size = [self.flat], np.zeros(len(units), np.int64)
        at, odd = np.flatnonzero(kind == 1), np.flatnonzero(kind == 0)
        for a in range(0, len(at), JOINED):
            ids = np.array(self.bare.encode_batch_fast([" ".join([units[i] for i in at[a : a + JOINED].tolist()])], add_special_tokens=False)[0].ids, np.uint32)
            flat.append(ids)
            size[at[a : a + JOINED]] = np.diff(np.flatnonzero(self.ending[ids]), prepend=-1)
        ids = self.whole([units[i] for i in odd.tolist()])
        size[odd] = [len(x) for x in ids]
        order = np.concatenate([at, odd])  # as they lie in the flat table
        start = np.zeros(len(units), np.int64)
        start[order] = len(self.flat) + np.cumsum(size[order]) - size[order]
        self.flat = np.concatenate([*flat, *ids])
        self.start, self.size = np.append(self.start, start), np.append(self.size, size)
        self.start[made[:, 0]] = len(self.flat) + self.size[made[:, 1:]].sum(1).cumsum() - self.size[made[:, 1:]].sum(1)
        self.flat = np.append(self.flat, self.gather(made[:, 1:].ravel()))
        self.size[made[:, 0]] = self.size[made[:, 1:]].sum(1)

    def gather(self, units: np.ndarray) -> np.ndarray:
        """Ids of units, one after another."""
        size = self.size[units]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.start[units] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text and the end id."""
        if len(self.number) > MEMO:
            self.forget()
        codes, odd, known = [], {}, len(self.number)
        get = self.number.__getitem__
        for i, text in enumerate(texts):
            if any(s in text for s in self.special) or _CONTROL.search(text):
                odd[i] = text
                codes.append(np.empty(0, np.int64))
                continue
            text = unicodedata.normalize("NFC", text)
            # the normaliser looks at each character by itself, Python at the place of a final sigma
            text = "".join(map(str.lower, text)) if "\u03a3" in text else text.lower()
            units = text.split()
            units.append("")
            codes.append(np.fromiter(map(get, units), np.int64, len(units)))
        if len(self.number) > known:
            self.learn(known)
        out = [self.gather(own) for own in codes]
        for i, ids in zip(odd, self.whole(list(odd.values()))):
            out[i] = np.append(ids, np.uint32(self.end))
        return out


@lru_cache(maxsize=2)
def encoder(path: str, end: int) -> WordEncoder:
    """One encoder a worker process."""
    return WordEncoder(path, end)


def pieces(df: DataFrame, path: str, end: int = 1, most: int = 4096, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Token pieces of each whole text: ``uid, doc_id, piece, start, length, ids_crc32``, and ``ids`` if asked for.

    A document's ids are those of its text and ``end``; only longer ones than ``most`` are cut, each piece full but
    the last. ``uid`` numbers pieces by input partition and place in it. No shuffle.
    """
    rows = texts(df, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, uid = encoder(path, end), TaskContext.get().partitionId() << 40
        for batch, own in slices(batches):
            at, out = [], [[], [], [], [], [], []]
            for i, ids in enumerate(enc(own)):
                for k, a in enumerate(range(0, len(ids), most)):
                    own_ids = ids[a : a + most]
                    at.append(i)
                    for column, x in zip(out, (uid, k, a, len(own_ids), zlib.crc32(own_ids.astype("<u4", copy=False).tobytes()), own_ids.astype(np.int32) if with_ids else None)):
                        column.append(x)
                    uid += 1
            arrays = [pa.array(out[0], pa.int64()), batch.column(0).take(pa.array(at, pa.int64())), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:5])]
            names = ["uid", "doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays, names = [*arrays, pa.array(out[5], pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return rows.mapInArrow(run, f"uid long, doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


PLACED, WAITING, FREE, USED = 0, 1, 2, 3
_STATE = "part int, kind int, rank long, id long, size long, seq long"


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of documents and gaps by falling size, gaps first among equals: each document takes the smallest gap
    seen and not used up, its successor. A gap goes on taking documents while they fit.

    Out come placed documents, waiting ones with their rank (largest first), free gaps with their rank (smallest first)
    and gaps that took something. Lists hold no more than the range.
    """
    part = TaskContext.get().partitionId()
    free: list[tuple[int, int]] = []
    waiting = 0
    used: tuple | None = None
    for batch in batches:
        out = []
        for size, kind, key in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if kind == 0:
                free.append((size, key))  # smaller than any free one before
                if used:  # a fresh gap is a tighter fit than what is left of an older one only if smaller
                    out.append((part, USED, 0, -1, used[0], used[1]))
                    used = None
                continue
            if used and used[0] < size:
                out.append((part, USED, 0, -1, used[0], used[1]))
                used = None
            if not used and free:
                used = free.pop()
            if used:
                out.append((part, PLACED, 0, key, size, used[1]))
                used = (used[0] - size, used[1])
            else:
                out.append((part, WAITING, waiting, key, size, -1))
                waiting += 1
        if out:
            yield _state(out)
    out = [(part, USED, 0, -1, *used)] if used else []
    out += [(part, FREE, i, -1, *x) for i, x in enumerate(reversed(free))]
    for i in range(0, len(out), 100_000):
        yield _state(out[i : i + 100_000])


def _state(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in _STATE.split(", ")])


def _across(counts: dict[int, dict[int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Which waiting documents of one range go to which free gaps of a range of larger sizes: by rank, the nearest
    range first. (document range, first rank, gap range, first rank, how many, first number of the match).

    The input is two counts a range, so this is as long as there are ranges, whatever the number of documents.
    """
    stack: list[list[int]] = []  # range, first rank not taken, left
    out, number = [], 0
    for part in sorted(counts):
        need, rank = counts[part].get(WAITING, 0), 0
        while need and stack:
            top = stack[-1]
            n = min(need, top[2])
            out.append((part, rank, top[0], top[1], n, number))
            number, rank, need = number + n, rank + n, need - n
            top[1], top[2] = top[1] + n, top[2] - n
            if not top[2]:
                stack.pop()
        if counts[part].get(FREE):
            stack.append([part, 0, counts[part][FREE]])
    return out


class _Tally:
    """Numbers of rows by range, kind and size after a sweep: all that the driver sees of a round. Sizes are at most
    ``most``, and only a size on a border is in two ranges, so there are ``most`` and a few a range whatever the number of documents."""

    def __init__(self, rows: list):
        self.by: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for r in rows:
            self.by.setdefault(r["part"], {}).setdefault(r["kind"], []).append((r["size"], r["n"]))
        for kinds in self.by.values():
            kinds.get(WAITING, []).sort(reverse=True)
            kinds.get(FREE, []).sort()
        self.links = _across({p: {k: sum(n for _, n in x) for k, x in kinds.items()} for p, kinds in self.by.items()})

    def after(self) -> tuple[Counter, int]:
        """Sizes of the documents that wait after the matches, and the largest gap left."""
        taken: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for dpart, drank, gpart, grank, n, _ in self.links:
            taken.setdefault((dpart, WAITING), []).append((drank, n))
            taken.setdefault((gpart, FREE), []).append((grank, n))

        def sizes(part: int, kind: int, stretches: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
            """Sizes of the ranks in the stretches, and how often."""
            runs, at = self.by[part].get(kind, []), 0
            for size, n in runs:
                for first, many in stretches:
                    if (own := min(at + n, first + many) - max(at, first)) > 0:
                        yield size, own
                at += n

        left: Counter = Counter()
        gap = 0
        for part, kinds in self.by.items():
            for size, n in kinds.get(WAITING, []):
                left[size] += n
            for size, n in sizes(part, WAITING, taken.get((part, WAITING), [])):
                left[size] -= n
            free = Counter(dict(kinds.get(FREE, [])))
            for size, n in sizes(part, FREE, taken.get((part, FREE), [])):
                free[size] -= n
            gap = max([gap, *(s for s, n in free.items() if n), *(s for s, _ in kinds.get(USED, []))])
        for dpart, drank, gpart, grank, n, _ in self.links:  # what the matches leave of their gaps, in order of rank
            docs = list(sizes(dpart, WAITING, [(drank, n)]))
            room = list(sizes(gpart, FREE, [(grank, n)]))
            i = j = 0
            while i < len(docs) and j < len(room):
                gap = max(gap, room[j][0] - docs[i][0])
                m = min(docs[i][1], room[j][1])
                docs[i], room[j] = (docs[i][0], docs[i][1] - m), (room[j][0], room[j][1] - m)
                i, j = i + (not docs[i][1]), j + (not room[j][1])
        return +left, gap


def _needed(sizes: Counter, gap: int, most: int) -> int:
    """Sequences that must be opened for the documents larger than every gap: their sum asks for so many, and so does each
    class of those of which no more than ``k`` go into one. Never more than any packing needs for them."""
    large = {s: n for s, n in sizes.items() if s > gap}
    need = -(-sum(s * n for s, n in large.items()) // most)
    for k in range(1, 9):
        need = max(need, -(-sum(n for s, n in large.items() if s * (k + 1) > most) // k))
    return need


def best_fit(items: DataFrame, most: int = 4096) -> DataFrame:
    """Places of items (``id, size`` with 1 <= size <= ``most``) in sequences of ``most``: ``id, seq``, seq from 0.

    Rounds: items that wait and gaps are sorted by size over ranges; every range is swept at once, each item taking the
    smallest gap that holds it; what waits after that takes free gaps of ranges of larger sizes by rank; gaps shrink by
    what they took; repeat. Before each round as many sequences are opened as the items larger than every gap need at
    least (``_needed``), so each round places something and none opens more than it must. A round's state is a
    written table, so it is computed once and outlives executors; ranges are as many as the rows ask for (``RANGE``). The driver
    sees numbers of rows by range and size. Equal sizes are ordered by id, so a frequent size spreads over ranges.
    """
    spark = items.sparkSession
    waiting, gaps, opened, tables, placed = items.select("id", "size"), None, 0, [], []
    sizes, gap, room = Counter({r["size"]: r["n"] for r in waiting.groupBy("size").agg(F.count("*").alias("n")).collect()}), 0, 0
    if not sizes:
        return spark.createDataFrame([], "id long, seq long")
    while sizes:
        if new := _needed(sizes, gap, most):
            fresh = spark.range(opened, opened + new).select(F.col("id").alias("seq"), F.lit(most).cast("long").alias("size"))
            gaps, opened, room = (fresh if gaps is None else gaps.unionByName(fresh)), opened + new, room + new
        mixed = waiting.select("size", F.lit(1).alias("kind"), "id").unionAll(gaps.select("size", F.lit(0).alias("kind"), F.col("seq").alias("id")))
        order = [F.desc("size"), F.asc("kind"), F.asc("id")]
        ranges = -(-(sizes.total() + room) // RANGE)
        dealt = mixed.repartitionByRange(ranges, *order) if ranges > 1 else mixed.coalesce(1)  # one range needs no borders
        swept = cut(dealt.sortWithinPartitions(*order).mapInArrow(_sweep, _STATE), "swept")
        tables.append(swept)
        tally = _Tally(swept.where(F.col("size") > 0).groupBy("part", "kind", "size").agg(F.count("*").alias("n")).collect())
        placed.append(swept.where(F.col("kind") == PLACED).select("id", "seq"))
        waiting = swept.where(F.col("kind") == WAITING).select("id", "size")
        gaps = swept.where((F.col("kind") == USED) & (F.col("size") > 0)).select("seq", "size")
        free = swept.where(F.col("kind") == FREE)
        if tally.links:
            links = F.broadcast(spark.createDataFrame(tally.links, "dpart int, drank long, gpart int, grank long, n long, number long"))
            docs = swept.where(F.col("kind") == WAITING).join(links, (F.col("part") == F.col("dpart")) & (F.col("rank") >= F.col("drank")) & (F.col("rank") < F.col("drank") + F.col("n")), "left").select("id", "size", (F.col("number") + F.col("rank") - F.col("drank")).alias("match"))
            free = free.join(links, (F.col("part") == F.col("gpart")) & (F.col("rank") >= F.col("grank")) & (F.col("rank") < F.col("grank") + F.col("n")), "left").select("seq", "size", (F.col("number") + F.col("rank") - F.col("grank")).alias("match"))
            met = cut(docs.where("match IS NOT NULL").join(free.where("match IS NOT NULL").withColumnRenamed("size", "room"), "match").select("id", "size", "seq", "room"), "met")
            tables.append(met)
            placed.append(met.select("id", "seq"))
            waiting, free = docs.where("match IS NULL").select("id", "size"), free.where("match IS NULL")
            gaps = gaps.unionAll(met.where("room > size").select("seq", (F.col("room") - F.col("size")).alias("size")))
        gaps = gaps.unionAll(free.select("seq", "size"))
        sizes, gap = tally.after()
    out = placed[0]
    for x in placed[1:]:
        out = out.unionAll(x)
    out = cut(out, "packed")
    drop_cut(*tables)
    return out


def pack(df: DataFrame, path: str, end: int = 1, most: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``most`` tokens; a row a piece.

    ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. Full pieces have a sequence of their own (ids below 0),
    the others are packed by ``best_fit``; within a sequence pieces lie by their number without gaps. A null text is
    an empty one: its piece is the end id alone. Repeated rows and null ids are documents like any other; an empty table
    gives none; other columns are not looked at. Texts are read once; only (number, length) is shuffled.
    """
    made = cut(pieces(df, path, end, most, id_col, text_col), "pieces")
    places = best_fit(made.where(F.col("length") < most).select(F.col("uid").alias("id"), F.col("length").alias("size")), most)
    full = made.where(F.col("length") == most).withColumn("sequence_id", -F.col("uid") - 1).withColumn("offset", F.lit(0).cast("long"))
    shared = made.where(F.col("length") < most).join(places.select(F.col("id").alias("uid"), F.col("seq").alias("sequence_id")), "uid")
    before = Window.partitionBy("sequence_id").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)
    shared = shared.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    return full.unionByName(shared).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
