"""Exact token counts at every prefix, by dynamic programming over a piece vocabulary."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from evispan.llm._common import slices, texts

GAP, INF = "▁", float("inf")
#: Entries that a worker's table of units may hold before it is emptied: memory only, never a result.
MEMO = 700_000


class PrefixCounter:
    """Token counts of byte-pair pieces with byte fallback, for every prefix of a text.

    A tokenisation is the encoder's own exactly if every token encodes to itself and every two neighbours,
    encoded together, stay two tokens. So a prefix ends in the one piece t that fits the last token of
    the prefix before t, and count(prefix) = count(prefix before t) + 1: one pass over the text.

    Merges never cross a place whose two characters are neighbours in no piece; texts fall apart there into
    units, whose counts add up. Those of a unit are kept while the worker lives.
    """

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.rank = {sp.id_to_piece(i): -sp.get_score(i) for i in plain}
        self.longest = max(map(len, self.rank))
        self.near = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        # the two steps below need that a gap starts words only, and that line ends are in no piece
        self.simple = not any("\n" in p for p in self.rank) and not any(b[1] == GAP and b[0] != GAP for b in self.near)
        self.memo: dict[str, int] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.stories: dict[str, tuple] = {}

    def _story(self, piece: str) -> tuple[list[float], list[str], list[str], bool]:
        """How a piece comes about by itself: rank of each merge in turn (then infinity), its first and last symbol
        before each, and whether it ends as one token."""
        if (found := self.stories.get(piece)) is None:
            symbols, ranks, first, last = list(piece), [], [], []
            while True:
                first.append(symbols[0])
                last.append(symbols[-1])
                rank, i = min(((self.rank.get(a + b, INF), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:]))), default=(INF, 0))
                ranks.append(rank)
                if rank == INF:
                    break
                symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            found = self.stories[piece] = ranks, first, last, len(symbols) == 1
        return found

    def _fit(self, a: str, b: str) -> bool:
        """Whether two tokens, encoded together, stay these two: both stories are told at once, best rank first
        and leftmost on ties, until a merge across the border would come first or nothing is left."""
        if (found := self.fits.get((a, b))) is None:
            if len(self.fits) > MEMO:
                self.fits.clear()
            (ra, _, last, _), (rb, first, _, _), i, j, found = self._story(a), self._story(b), 0, 0, True
            rank = self.rank
            while found:
                left, right, across = ra[i], rb[j], rank.get(last[i] + first[j], INF)
                if across < left and across <= right:
                    found = False
                elif left <= right:
                    if left == INF:
                        break
                    i += 1
                else:
                    j += 1
            self.fits[a, b] = found
        return found

    def prefixes(self, unit: str) -> list[int]:
        """Token count of each prefix of a unit, the empty one first. Characters without a piece count their UTF-8 bytes."""
        counts, last, rank, longest = [0], [""], self.rank, self.longest
        for end in range(1, len(unit) + 1):
            if unit[end - 1] not in rank:
                counts.append(counts[-1] + len(unit[end - 1].encode()))
                last.append("")
                continue
            for start in range(max(0, end - longest), end):
                piece = unit[start:end]
                if piece in rank and (end - start == 1 or self._story(piece)[3]) and (not last[start] or self._fit(last[start], piece)):
                    counts.append(counts[start] + 1)
                    last.append(piece)
                    break
            else:
                raise AssertionError(f"no last token for {unit[:end]!r}")
        return counts

    def _parts(self, unit: str) -> list[str]:
        cuts = [i for i in range(1, len(unit)) if unit[i - 1 : i + 1] not in self.near]
        return [unit[a:b] for a, b in zip([0, *cuts], [*cuts, len(unit)])]

    def units(self, text: str) -> list[str]:
        """Parts of the escaped text between which nothing merges; line ends stand alone."""
        if not text:
            return []
        if not self.simple or "\0" in text:
            return self._parts(GAP + text.replace(" ", GAP))
        return (GAP + text.replace("\n", "\0\n\0").replace(" ", f"\0{GAP}")).replace(f"{GAP}\0{GAP}", GAP * 2).replace(f"{GAP}\0{GAP}", GAP * 2).split("\0")

    def of_unit(self, unit: str) -> int:
        if (found := self.memo.get(unit)) is None:
            found = 0
            for part in self._parts(unit):
                if (n := self.memo.get(part)) is None:
                    n = self.prefixes(part)[-1]
                    if len(part) <= 64:
                        self.memo[part] = n
                found += n
            if len(unit) <= 64:
                self.memo[unit] = found
        return found

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        units = self.units(text)
        for new in set(units).difference(self.memo):
            if len(new) > 64:
                return sum(map(self.of_unit, units))
            self.of_unit(new)
        return sum(map(self.memo.__getitem__, units))

    def at_prefixes(self, text: str) -> list[int]:
        """Token count of every prefix of a text by code points: entry i for ``text[:i]``."""
        if not text:
            return [0]
        escaped, out, base = GAP + text.replace(" ", GAP), [], 0
        for part in self._parts(escaped):
            counts = self.prefixes(part)
            out += [base + n for n in counts[1:]]
            base += counts[-1]
        return [0, *out[1:]]  # the gap put in front is no code point of the text; an empty prefix has no tokens

    def longest_prefix(self, text: str, budget: int) -> int:
        """Most code points from the start that take at most ``budget`` tokens (a longer prefix may take fewer)."""
        return max(i for i, n in enumerate(self.at_prefixes(text)) if n <= budget)


@lru_cache(maxsize=2)
def counter(model: str) -> PrefixCounter:
    """One counter a worker process; it reads only the vocabulary file."""
    return PrefixCounter(model)


def count_tokens(df: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token count of each whole text: ``doc_id, n_bytes, n_tokens, over_limit`` (more than ``limit``).

    Null texts count as empty: 0 bytes, 0 tokens. Every input row gives one row, repeated ones too; the id may be
    null; an empty table gives none; other columns are not looked at. One pass, no shuffle: a task holds a slice
    of texts and a table of at most ``MEMO`` units.
    """
    rows = texts(df, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model)
        for batch, own in slices(batches):
            n = [c.count(t) for t in own]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t.encode()) for t in own], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def truncate(df: DataFrame, model: str, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The longest prefix of each text that fits a token budget: ``doc_id, kept_chars, kept_tokens, text``."""
    rows = texts(df, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model)
        for batch, own in slices(batches):
            at = [c.at_prefixes(t) for t in own]
            keep = [max(i for i, n in enumerate(x) if n <= budget) for x in at]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keep, pa.int64()), pa.array([x[k] for x, k in zip(at, keep)], pa.int64()), pa.array([t[:k] for t, k in zip(own, keep)], pa.string())], ["doc_id", "kept_chars", "kept_tokens", "text"])

    return rows.mapInArrow(run, f"doc_id {kind}, kept_chars long, kept_tokens long, text string")
