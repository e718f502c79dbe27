"""Document fingerprints after I-Match: terms of a document frequency band, hashed over random lexicon subsets."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from evispan.llm._common import parts, slices, texts

_WORD = re.compile(r"\w+")
#: Entries of a task's tables before they are emptied or passed on: memory only, never a result.
MEMO = 500_000


@dataclass(frozen=True)
class Band:
    """Which terms count. A term's document frequency must be from ``least`` to ``most`` of all documents, that is
    its inverse document frequency from -ln(most) to -ln(least).

    ``least`` bounds the lexicon, and so what is broadcast, at any number of documents: frequencies add up to the documents'
    distinct terms, so no more than (mean distinct terms of a document) / ``least`` terms reach it.
    """

    least: float = 0.005
    most: float = 0.05


#: Share of the lexicon in each random subset. Small subsets outlive large edits, large ones tell documents apart.
SHARES = tuple(1 / s for s in (24, 48, 64, 96, 128, 192, 256, 384)) * 8


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _terms(unit: str) -> list[str]:
    """Words of a part of a text between white space, in lower case."""
    return [unit.lower()] if unit.isalnum() else _WORD.findall(unit.lower())


def document_frequencies(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``term`` and ``df``, the number of documents with it, over all documents.

    A task counts its own documents' distinct terms and passes a count on for each term, so a frequent term costs the shuffle
    a row a task, whatever its frequency.
    """
    rows = texts(df, text_col, text_col).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, list[str]] = {}
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "df"])

        for _, own in slices(batches):
            for text in own:
                units = set(text.split())
                found: set[str] = set()
                for u in units:
                    if (t := memo.get(u)) is None:
                        t = memo[u] = _terms(u)
                    found.update(t)
                counts.update(found)
            if len(memo) > MEMO:
                memo.clear()
            if len(counts) > MEMO:
                yield out()
                counts.clear()
        yield out()

    return rows.mapInArrow(run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


def lexicon(df: DataFrame, band: Band = Band(), text_col: str = "text") -> list[str]:
    """The band's terms, sorted; ``Band`` says how many there can be. Fewer than two documents have none."""
    n = df.count()
    counts = document_frequencies(df, text_col).where((F.col("df") >= F.lit(max(2.0, band.least * n))) & (F.col("df") <= F.lit(max(2.0, band.most * n))))
    return sorted(counts.select("term").toArrow().column(0).to_pylist())


class Fingerprinter:
    """Fingerprints against one lexicon: a hash of 8 hex digits a subset, ``-`` where none of its terms occur.

    The last hash is over all terms of the band, as in the plain method; a text without such terms has that of its
    own words, so two of them are only alike if their words are.
    """

    def __init__(self, terms: list[str]):
        self.row = {t: i for i, t in enumerate(terms)}
        h = np.frombuffer(b"".join(hashlib.blake2b(t.encode(), digest_size=8).digest() for t in terms), "<u8")
        draws = np.stack([_mix(h ^ _mix(np.array([k + 1], np.uint64))) for k in range(len(SHARES))], 1) if len(h) else np.empty((0, len(SHARES)), np.uint64)
        self.member = draws < (np.array(SHARES) * 2.0**64).astype(np.uint64)
        self.raw = h
        self.hits: dict[str, list[int]] = {}  # units with terms of the lexicon, and those without
        self.none: set[str] = set()

    def __call__(self, text: str) -> str:
        hits, none, row, found = self.hits, self.none, self.row, set()
        if len(none) > MEMO:
            none.clear()
        if len(hits) > MEMO:
            hits.clear()
        for u in set(text.split()).difference(none):
            if (rows := hits.get(u)) is None:
                rows = [row[t] for t in _terms(u) if t in row]
                if not rows:
                    none.add(u)
                    continue
                hits[u] = rows
            found.update(rows)
        at = np.array(sorted(found), np.int64)  # rows of a sorted lexicon: terms in order, each once
        h, member, out = self.raw[at], self.member[at].T, ["-"] * len(SHARES)
        for k in np.flatnonzero(member.any(1)).tolist():
            out[k] = _hex(h[member[k]].tobytes())
        out.append(_hex(h.tobytes()) if found else _hex("\0".join(sorted(set(_WORD.findall(text.lower())))).encode() or text.encode()))
        return ".".join(out)


def _hex(raw: bytes) -> str:
    return hashlib.blake2b(raw, digest_size=4).hexdigest()


def likeness(a: str, b: str) -> float:
    """Share of equal subset hashes among subsets that either document has a term of; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    x, y = a.split("."), b.split(".")
    used = [(p, q) for p, q in zip(x, y) if p != "-" or q != "-"]
    return sum(p == q for p, q in used) / len(used)


def fingerprints(df: DataFrame, band: Band = Band(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` of every whole text. Equal texts have equal ones; null counts as empty; no shuffle of texts."""
    rows, lex = texts(df, id_col, text_col), df.sparkSession.sparkContext.broadcast(lexicon(df, band, text_col))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fp = Fingerprinter(lex.value)
        for batch, own in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(fp, own), pa.string())], ["doc_id", "fingerprint"])

    return rows.mapInArrow(run, f"doc_id {kind}, fingerprint string")


def with_next(rows: DataFrame) -> DataFrame:
    """``doc_id, text, next_text``: the text of the next document by descending id, after the last that of the first.

    Ids fall into ranges, as many as the session has shuffle partitions; within a range a window finds the next row. The
    first row of each range (the largest id) also goes to the range before as its end, so the text is shuffled once and no
    task sees more than a range. Rows with equal ids are next to each other by their text; null ids come last.
    """
    spark = rows.sparkSession
    n = parts(spark)
    key = F.col("doc_id")
    cuts = rows.select(F.percentile_approx(key, [i / n for i in range(1, n)], 10 * n) if n > 1 else F.array().alias("c")).first()[0] or []
    cuts = sorted(set(cuts), reverse=True)

    def place(c: Column) -> Column:
        return F.coalesce(F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda x: x > c)), F.lit(len(cuts))) if cuts else F.lit(0)

    heads = rows.groupBy(place(key).alias("range")).agg(F.max("doc_id").alias("head")).orderBy("range").collect()  # one row a range
    before = {r["head"]: heads[i - 1]["range"] for i, r in enumerate(heads)}  # of the first range: the last
    ends = F.lit(None).cast("int")
    for head, r in before.items():
        ends = F.when(key.eqNullSafe(F.lit(head)), F.lit(r)).otherwise(ends)
    # as a map, so that the plan doesn't grow with the ranges
    known = [(h, r) for h, r in before.items() if h is not None]
    if known:
        table = F.create_map(*[F.lit(x) for pair in known for x in pair])
        ends = F.coalesce(F.try_element_at(table, key), *([F.when(key.isNull(), F.lit(before[None]))] if None in before else []))
    both = rows.select("doc_id", "text", F.explode(F.filter(F.array(F.struct(place(key).alias("range"), F.lit(0).alias("end")), F.struct(ends.cast("int").alias("range"), F.lit(1).alias("end"))), lambda x: x["range"].isNotNull())).alias("at"))
    both = both.select("doc_id", "text", "at.range", "at.end")
    order = Window.partitionBy("range").orderBy("end", F.desc_nulls_last("doc_id"), "text")
    return both.withColumn("next_text", F.lead("text").over(order)).where("end = 0").select("doc_id", "text", "next_text")


def edit_fingerprints(df: DataFrame, band: Band = Band(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each whole text and of its edited text, whose last third is the start of the next document.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. The lexicon comes from the
    texts of all documents. A null text counts as empty; repeated rows each give a row; a table of one row is its own next;
    an empty table gives none; other columns are not looked at.
    """
    rows = texts(df, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if df.limit(1).count() == 0:
        return df.sparkSession.createDataFrame([], columns)
    lex = df.sparkSession.sparkContext.broadcast(lexicon(df, band, text_col))
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fp = Fingerprinter(lex.value)
        for batch, own in slices(batches, most=300_000):
            out: list[list] = [[] for _ in names[1:]]
            before = None
            for text, after in zip(own, batch.column(2).to_pylist()):
                m = len(text) // 3
                edited = text[: len(text) - m] + after[:m]
                # rows of a range come in order, so the next document's fingerprint is mostly made anyway: as the next row's own
                a = before[1] if before and before[0] == text else fp(text)
                b, c = fp(edited), fp(after)
                before = (after, c)
                for column, x in zip(out, (len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, likeness(a, b), likeness(a, c))):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out)], schema=pa.schema([batch.schema.field(0), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]))

    return with_next(rows).mapInArrow(run, columns)
