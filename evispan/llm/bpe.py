"""Byte-level BPE: encoding by batched numpy merge rounds, and decoding."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from evispan.llm._common import slices, texts

#: Entries that a worker's table of units may hold before it is emptied: memory only, never a result.
MEMO = 800_000
#: Unicode White_Space, spelled out so that no library's own idea of \s matters.
_SPACE = r"\t-\r \x85\xa0  -     　"
_DOUBLE = re.compile(r"\s\s")


def byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else one from 256 up."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class ByteBpe:
    """One vocabulary file of the ``tokenizers`` library: byte-level BPE without normaliser."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_letters()
        self.base = np.array([vocab[c] for c in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.wide = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        keys = np.array([vocab[a] * self.wide + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_at = keys[order], order
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        byte_of = {c: bytes([b]) for b, c in enumerate(letters)}
        self.pieces = [b""] * self.wide
        for token, i in vocab.items():
            self.pieces[i] = b"".join(map(byte_of.__getitem__, token))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.pieces[i] = token.encode()
        self.flat = np.frombuffer(b"".join(self.pieces), np.uint8)
        self.width = np.array([len(p) for p in self.pieces], np.int64)
        self.start = np.cumsum(self.width) - self.width
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.memo: dict[str, bytes] = {}

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word. All words' symbols lie in one array; a round merges, in every word at once, all places
        of that word's lowest-ranked pair, found by binary search over the sorted pair keys; words without a
        pair left drop out."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(words)
        lens = np.array([len(w) for w in words], np.int64)
        sym = self.base[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lens)
        none, last = len(self.made), len(self.keys) - 1

        def ranks(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            key = left * self.wide + right
            at = np.minimum(np.searchsorted(self.keys, key), last)
            return np.where(self.keys[at] == key, self.rank_at[at], none)

        ends = np.append(word[1:] != word[:-1], True) if len(word) else word
        rank = np.where(ends, none, ranks(sym, np.roll(sym, -1)))  # of each symbol with the next one in its word
        while len(sym):
            first = np.flatnonzero(np.r_[True, ends[:-1]])
            least, size = np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(sym)])
            if (done := least == none).any():
                for w, a, n in zip(word[first[done]].tolist(), first[done].tolist(), size[done].tolist()):
                    out[w] = sym[a : a + n]
                keep = np.repeat(~done, size)
                sym, word, rank, ends = sym[keep], word[keep], rank[keep], ends[keep]
                least, size = least[~done], size[~done]
                if not len(sym):
                    break
            hit = rank == np.repeat(least, size)
            if (hit[1:] & hit[:-1]).any():  # overlapping places, a run of one symbol: every second one, from the left
                i = np.arange(len(sym))
                begin = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], i, 0))
                hit &= (i - begin) % 2 == 0
            at = np.flatnonzero(hit)
            sym[at], ends[at] = self.made[rank[at]], ends[at + 1]
            gone = np.zeros(len(sym), bool)
            gone[at + 1] = True
            at = at - np.arange(len(at))  # where the merged symbols come to lie
            sym, word, rank, ends = sym[~gone], word[~gone], rank[~gone], ends[~gone]
            fresh = np.unique(np.r_[at, at[at > 0] - 1])
            rank[fresh] = np.where(ends[fresh], none, ranks(sym[fresh], sym[np.minimum(fresh + 1, len(sym) - 1)]))
        return out

    def units(self, text: str) -> list[str]:
        """The text in parts that are split into words each by itself. Where no two white space characters meet, that
        is before each space and around each line end; else the words themselves."""
        if "\0" in text or _DOUBLE.search(text):
            return self.words.findall(text)
        return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")

    def learn(self, new: Iterable[str]) -> None:
        """Put units into the table: their words are encoded in one batch."""
        split = self.words.findall
        found = {u: [u.encode()] if u[1:].isalpha() and (u[0] == " " or u[0].isalpha()) else [w.encode() for w in split(u)] for u in new}
        words = list(dict.fromkeys(w for own in found.values() for w in own))
        ids = dict(zip(words, (x.astype("<u4").tobytes() for x in self.encode_words(words)))) if words else {}
        self.memo.update((u, b"".join(map(ids.__getitem__, own))) for u, own in found.items())

    def encode_bytes(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, each as little-endian unsigned 32-bit integers."""
        cut = []  # for each text: units, or the bytes of a special token's id
        for text in texts:
            parts = self.at_special.split(text) if self.at_special and any(s in text for s in self.special) else [text]
            cut.append([(p, None) if i % 2 else (None, self.units(p)) for i, p in enumerate(parts)])
        if len(self.memo) > MEMO:
            self.memo.clear()
        get = self.memo.get
        found = [[get(u) for u in units or ()] for parts in cut for _, units in parts]
        self.learn({u for (_, units), own in zip((p for parts in cut for p in parts), found) if None in own for u, x in zip(units, own) if x is None})
        out, at = [], iter(found)
        for parts in cut:
            ids = []
            for special, units in parts:
                own = next(at)
                if special is not None:
                    ids.append(np.array([self.special[special]], "<u4").tobytes())
                else:
                    ids += own if None not in own else [self.memo[u] if x is None else x for u, x in zip(units, own)]
            out.append(b"".join(ids))
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes([text])[0], "<u4").tolist()

    def decode_bytes(self, ids: bytes) -> bytes:
        """UTF-8 of the decoded text; ill-formed sequences become U+FFFD, ids outside the vocabulary nothing."""
        n = np.frombuffer(ids, "<u4").astype(np.int64)
        n = n[n < self.wide]
        width = self.width[n]
        ends = np.cumsum(width)
        raw = self.flat[np.repeat(self.start[n] - ends + width, width) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        return raw.decode("utf-8", "replace").encode()

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(np.array(ids, "<u4").tobytes()).decode()


@lru_cache(maxsize=2)
def codec(path: str) -> ByteBpe:
    """One codec a worker process."""
    return ByteBpe(path)


def _map(df: DataFrame, path: str, columns: str, work, id_col: str, text_col: str) -> DataFrame:
    rows = texts(df, id_col, text_col)
    names = [c.split()[0] for c in columns.split(", ")]
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch, own in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), *work(c, own)], ["doc_id", *names])

    return rows.mapInArrow(run, f"doc_id {kind}, {columns}")


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` of each whole text. A null text counts as empty (no ids); every row gives one row; no shuffle."""

    def work(c: ByteBpe, own: list[str]) -> list[pa.Array]:
        ids = [np.frombuffer(x, "<u4") for x in c.encode_bytes(own)]
        ends = np.cumsum([0, *map(len, ids)])
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*ids, np.empty(0, "<u4")]).astype(np.int32)))]

    return _map(df, path, "ids array<int>", work, id_col, text_col)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` of each list of ids. A null list, and null ids in one, count as nothing."""
    rows = df.selectExpr(f"`{id_col}` AS doc_id", f"coalesce(filter(`{ids_col}`, x -> x IS NOT NULL), array()) AS ids")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.decode(x) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {kind}, text string")


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each whole text and decode its ids: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    Ids and text are made and hashed in the same task, so neither is stored or shuffled. Special strings in a text
    become their special id, as the library's default has it. A null text counts as empty; the id may be null;
    repeated rows each give a row; an empty table gives none; other columns are not looked at. A task holds
    a slice of texts and a table of at most ``MEMO`` units.
    """

    def work(c: ByteBpe, own: list[str]) -> list[pa.Array]:
        ids = c.encode_bytes(own)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(sha, ids), pa.string()), pa.array([sha(c.decode_bytes(x)) for x in ids], pa.string())]

    return _map(df, path, "n_tokens long, ids_sha256 string, decoded_sha256 string", work, id_col, text_col)
