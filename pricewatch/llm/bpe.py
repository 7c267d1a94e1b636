"""Byte-level BPE encoding and decoding with numpy matrices.

A task cuts texts into pieces by the tokenizer's pattern and looks up pieces that it has met before. New pieces of a slice
go through the merger together: pieces of like length (buckets) are rows of a padded matrix of token ids, a second matrix
holds the rank of each neighbouring pair. Each round every row merges its leftmost pair of least rank and closes the gap;
only the two pairs beside the merge are looked up again, in a hash table of pairs laid out in numpy arrays. Rows without a
pair left leave the matrix.

Rules: null text is empty; an empty text has no ids. No special tokens: their strings are ordinary text. Ids out of range
or null do not decode: an error, not a guess. Memory of a task: one slice of texts, its pieces and a bounded cache.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewatch.llm.shared import map_texts, slices

NONE = np.int32(2**31 - 1)
EMPTY = np.int64(-1)
#: Pieces a task remembers, with four ids each on average; beyond that it starts anew.
CACHE_PIECES = 300_000
#: Cells of a matrix.
CELLS = 1 << 22


class Ranks:
    """A vocabulary as arrays: bytes of each id, ids of single bytes, and a hash table from pairs of ids to merged ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values()) + 1
        parts = [b""] * size
        for token, i in ranks.items():
            parts[i] = token
        self.lengths = np.fromiter(map(len, parts), dtype=np.int64, count=size)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.flat = np.frombuffer(b"".join(parts), dtype=np.uint8)
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        keys, values = [], []
        for token, i in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(i)
        self._fill(np.array(keys, dtype=np.int64), np.array(values, dtype=np.int32))

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ (h >> np.uint64(29))) >> self.shift).astype(np.int64)

    def _fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, EMPTY), np.full(1 << bits, NONE, dtype=np.int32)
        at, left = self._slots(keys) & self.mask, np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] == EMPTY]
            self.keys[at[free]] = keys[free]  # of several for one slot, the last stays
            won = self.keys[at[left]] == keys[left]
            self.values[at[left[won]]] = values[left[won]]
            left = left[~won]
            at[left] = (at[left] + 1) & self.mask

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Id of the merged pair, NONE if there is none."""
        keys = a.astype(np.int64) << 32 | b
        at = self._slots(keys) & self.mask
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], NONE)
        left = np.flatnonzero((found != keys) & (found != EMPTY))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            found = self.keys[at[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (found != EMPTY)]
        return out

    def merge_rows(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and how many each has. Buckets of like length, cut so that a matrix stays within CELLS."""
        n = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        flat = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        starts = np.cumsum(n) - n
        order = np.argsort(n, kind="stable")
        ordered = n[order]
        made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # places of pieces, their counts, their ids in a row
        at = int(np.searchsorted(ordered, 1))
        while at < len(order):
            low = int(ordered[at])
            end = int(np.searchsorted(ordered, low + low // 4, side="right"))
            end = min(end, at + max(1, CELLS // int(ordered[end - 1])))
            rows = order[at:end]
            if len(rows) == 1 and n[rows[0]] > 4096:
                ids = self._merge_long(flat[starts[rows[0]]:starts[rows[0]] + n[rows[0]]])
                made.append((rows, np.array([len(ids)]), ids))
            else:
                made += self._merge(flat, starts[rows], n[rows], rows)
            at = end
        counts = np.zeros(len(pieces), dtype=np.int64)
        if not made:
            return np.zeros(0, dtype=np.int32), counts
        where, sizes, ids = (np.concatenate(x) for x in zip(*made))
        counts[where] = sizes
        begins = np.zeros(len(pieces), dtype=np.int64)
        begins[where] = np.cumsum(sizes) - sizes
        return ids[runs(begins, counts)], counts

    def _merge(self, flat: np.ndarray, starts: np.ndarray, n: np.ndarray, live: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        width = int(n.max())
        columns = np.arange(width)
        inside = columns < n[:, None]
        ids = np.where(inside, self.bytes[flat[np.minimum(starts[:, None] + columns, len(flat) - 1)]], np.int32(-1))
        ranks = np.full(ids.shape, NONE, dtype=np.int32)
        pairs = inside[:, 1:]
        ranks[:, :-1][pairs] = self.merged(ids[:, :-1][pairs], ids[:, 1:][pairs])
        made = []
        while len(live):
            m = ranks.argmin(axis=1)
            new = ranks[np.arange(len(live)), m]
            done = new == NONE
            if done.any():
                made.append((live[done], n[done], ids[done][np.arange(ids.shape[1]) < n[done][:, None]]))
                go = np.flatnonzero(~done)
                if not len(go):
                    break
                width = int(n[go].max())
                ids, ranks, n, live, m, new = ids[go, :width], ranks[go, :width], n[go], live[go], m[go], new[go]
            row = np.arange(len(live))
            ids[row, m] = new
            columns = np.arange(ids.shape[1] - 1)  # close the gap right of m
            ids = np.where(columns > m[:, None], ids[:, 1:], ids[:, :-1])
            ranks = np.where(columns >= m[:, None], ranks[:, 1:], ranks[:, :-1])
            n = n - 1
            right, last, left = np.flatnonzero(m < n - 1), np.flatnonzero((m == n - 1) & (m < ranks.shape[1])), np.flatnonzero(m > 0)
            ranks[last, m[last]] = NONE
            ranks[right, m[right]] = self.merged(ids[right, m[right]], ids[right, m[right] + 1])
            ranks[left, m[left] - 1] = self.merged(ids[left, m[left] - 1], ids[left, m[left]])
        return made

    def _merge_long(self, piece: np.ndarray) -> np.ndarray:
        """A very long piece by itself. A round merges, for the least rank, all its pairs from the left that don't overlap.

        That is what merging the leftmost one again and again does, as long as no merge makes a pair of a lower rank beside
        it; a run of merges is cut before the first that does.
        """
        ids = self.bytes[piece]
        ranks = self.merged(ids[:-1], ids[1:])
        while len(ranks):
            least = ranks.min()
            if least == NONE:
                break
            at = np.flatnonzero(ranks == least)
            keep, last = [], -2
            for p in at.tolist():
                if p > last + 1:
                    keep.append(p)
                    last = p
            chosen = np.array(keep)
            new = ids.copy()
            new[chosen] = least
            gone = np.zeros(len(ids), dtype=bool)
            gone[chosen + 1] = True
            moved = chosen - np.arange(len(chosen))
            merged = new[~gone]
            again = self.merged(merged[:-1], merged[1:])
            beside = np.concatenate([moved - 1, moved])
            beside = beside[(beside >= 0) & (beside < len(again))]
            lower = beside[again[beside] < least]
            if len(lower):  # merge only up to the one whose merge makes the first such pair
                stop = int(np.searchsorted(moved, lower.min(), side="left")) + 1
                while True:
                    chosen = np.array(keep[:stop])
                    gone[:] = False
                    gone[chosen + 1] = True
                    new = ids.copy()
                    new[chosen] = least
                    merged = new[~gone]
                    again = self.merged(merged[:-1], merged[1:])
                    moved = chosen - np.arange(len(chosen))
                    beside = np.concatenate([moved[:-1] - 1, moved[:-1]])
                    beside = beside[(beside >= 0) & (beside < len(again))]
                    if stop == 1 or not (again[beside] < least).any():
                        break
                    stop -= 1
            ids, ranks = merged, again
        return ids


class Known(dict):
    """Numbers of pieces in the order in which they were first asked for."""

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


class Encoder:
    """Texts to ids with a bounded memory of pieces."""

    def __init__(self, vocabulary: Ranks, pattern: str):
        self.vocabulary, self.find = vocabulary, regex.compile(pattern).findall
        self._clear()

    def _clear(self) -> None:
        self.known = Known()
        self.ids, self.counts = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin (one more offset than texts)."""
        if len(self.counts) > CACHE_PIECES or len(self.ids) > 4 * CACHE_PIECES:
            self._clear()
        known, before, ask = self.known, len(self.known), self.known.__getitem__
        places, ends = [], np.zeros(len(texts) + 1, dtype=np.int64)
        for i, t in enumerate(texts):
            found = np.fromiter(map(ask, self.find(t)), dtype=np.int32)
            places.append(found)
            ends[i + 1] = ends[i] + len(found)
        if len(known) > before:
            ids, counts = self._encode(list(islice(known, before, None)))
            self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
        place = np.concatenate([np.zeros(0, dtype=np.int32), *places])
        counts = self.counts[place]
        begins = np.cumsum(self.counts) - self.counts
        return self.ids[runs(begins[place], counts)], np.concatenate([[0], np.cumsum(counts)])[ends]

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and how many each has. A piece that is a token as a whole is that token."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        whole = np.fromiter((self.vocabulary.ranks.get(r, -1) for r in raw), dtype=np.int32, count=len(raw))
        todo = np.flatnonzero(whole < 0)
        made, sizes = self.vocabulary.merge_rows([raw[i] for i in todo.tolist()])
        counts = np.ones(len(raw), dtype=np.int64)
        counts[todo] = sizes
        ids = np.repeat(whole, counts)
        ids[np.repeat(whole < 0, counts)] = made
        return ids, counts


def runs(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices begins[i], begins[i] + 1, ... of counts[i] each, end to end."""
    ends = np.cumsum(counts)
    return np.repeat(begins - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


@lru_cache(maxsize=2)
def _vocabulary(items: tuple[bytes, ...]) -> Ranks:
    return Ranks({base64.b64decode(a): int(b) for a, b in map(bytes.split, items)})


def load_ranks(path: str) -> list[bytes]:
    """Lines of a .tiktoken file, read on the driver and sent to the tasks; their number is the vocabulary's size."""
    with open(path, "rb") as f:
        return [line for line in f.read().split(b"\n") if line.strip()]


def encode(docs: DataFrame, path: str, pattern: str, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The columns in `keep` (doc_id by default) and ids array<int>."""
    lines = docs.sparkSession.sparkContext.broadcast(load_ranks(path))

    def make():
        encoder = Encoder(_vocabulary(tuple(lines.value)), pattern)

        def work(texts: list[str]) -> list[pa.Array]:
            ids, offsets = encoder(texts)
            return [pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pa.array(ids, type=pa.int32()))]

        return work

    return map_texts(docs, keep or ["doc_id"], text_col, [("ids", "array<int>")], make, rows=1024)


def decode(rows: DataFrame, path: str, keep: list[str], ids_col: str = "ids") -> DataFrame:
    """The columns in `keep` and decoded binary: the bytes of the ids, end to end. Null ids are an empty list."""
    lines = rows.sparkSession.sparkContext.broadcast(load_ranks(path))
    base = rows.select(*keep, F.coalesce(rows[ids_col], F.array().cast("array<int>")).alias("__ids"))
    schema = T.StructType([base.schema[c] for c in keep] + [T.StructField("decoded", T.BinaryType())])

    def run(batches):
        v = _vocabulary(tuple(lines.value))
        for batch in batches:
            for part in slices(batch, 256, 1 << 20):
                column = part.column(len(keep))
                offsets = column.offsets.to_numpy() - column.offsets[0].as_py()
                ids = column.flatten().to_numpy(zero_copy_only=False)
                if len(ids) and (ids.min() < 0 or ids.max() >= len(v.lengths) or (v.lengths[ids] == 0).any()):
                    raise ValueError("an id is not in the vocabulary")
                n = v.lengths[ids]
                ends = np.concatenate([[0], np.cumsum(n)])
                flat = v.flat[runs(v.starts[ids], n)]
                data = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(part), [None, pa.py_buffer(ends[offsets].astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + [data], names=schema.names)

    return base.mapInArrow(run, schema)
