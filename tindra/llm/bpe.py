"""Byte-level BPE encoding and decoding on length-bucketed padded numpy matrices.

A text is cut at its single spaces, each part is cut into the tokenizer's matches, and each distinct match is encoded once
per worker. New matches are bucketed by length into padded matrices of token ids; in each round every row finds its
leftmost minimum-rank pair through a hash table of pairs, merges it and is compacted. Rows without a pair leave. Matches
over LONG bytes use a heap over a linked list instead (same merges, n log n steps), so that one huge word stays cheap.

Defined results: a null or empty text has no ids; lone surrogates can't occur in Parquet strings; repeated rows give
repeated rows; an empty table gives no rows; very long texts and matches are encoded whole; equal ranks: the leftmost pair
merges first; other columns are not read. Memory: caches are emptied at CACHE entries. Patterns: the cut at single spaces holds
for patterns of the GPT-2 family, in which a match may begin with one space and white space else stands alone.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, small_batches

CACHE = 450_000
LONG = 256
NONE = np.int32(2**31 - 1)


class PairTable:
    """(left id, right id) -> rank, open addressing with linear probing in numpy arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        left = np.arange(len(keys))
        at = self._slot(keys)
        while len(left):
            free = self.keys[at] == -1
            order = np.unique(at[free], return_index=True)[1]
            won = np.flatnonzero(free)[order]
            self.keys[at[won]], self.values[at[won]] = keys[left[won]], values[left[won]]
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, at = left[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 20) | right
        shape, key = key.shape, key.ravel()
        at = self._slot(key)
        got = self.keys[at]
        out = np.where(got == key, self.values[at], NONE)
        todo = np.flatnonzero((got != key) & (got != -1))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            got = self.keys[at[todo]]
            hit = got == key[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (got != -1)]
        return out.reshape(shape)


class ByteBPE:
    def __init__(self, vocabulary: bytes, pattern: str) -> None:
        """vocabulary: the content of a .tiktoken file; pattern: the regular expression whose matches are encoded apart."""
        import regex

        self.find = regex.compile(pattern).findall
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.byte_id = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        keys, values = [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a << 20 | b)
                    values.append(rank)
        self.pair = dict(zip(keys, values, strict=True))
        self.table = PairTable(np.array(keys, np.int64), np.array(values, np.int32))
        self.parts: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    # ---- merging
    def _matrix(self, rows: list[bytes], out: dict[bytes, bytes]) -> None:
        """All rows have the same padded width; fills out[row] with packed ids."""
        width = max(map(len, rows))
        flat = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(len(rows), width)
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        ids = np.where(np.arange(width) < size[:, None], self.byte_id[flat], -1).astype(np.int32)
        index = np.arange(len(rows))
        while len(index):
            col = np.arange(ids.shape[1])
            rank = np.where(ids[:, 1:] >= 0, self.table.get(np.maximum(ids[:, :-1], 0), np.maximum(ids[:, 1:], 0)), NONE) if ids.shape[1] > 1 else np.full((len(index), 1), NONE)
            at = rank.argmin(axis=1)  # the first minimum is the leftmost pair
            best = rank[np.arange(len(index)), at]
            if (done := best == NONE).any():
                packed, wide = ids[done].astype("<u4").tobytes(), 4 * ids.shape[1]
                for k, (i, n) in enumerate(zip(index[done].tolist(), size[done].tolist(), strict=True)):
                    out[rows[i]] = packed[k * wide : k * wide + 4 * n]
                keep = ~done
                ids, index, size, at, best = ids[keep], index[keep], size[keep], at[keep], best[keep]
                if not len(index):
                    return
            ids[np.arange(len(index)), at] = best
            ids = np.take_along_axis(ids, np.minimum(col + (col > at[:, None]), ids.shape[1] - 1), axis=1)
            size = size - 1
            ids[col >= size[:, None]] = -1
            ids = ids[:, : size.max()]

    def _heap(self, piece: bytes) -> bytes:
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        nxt, prv, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.pair.get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i] if live[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], live[j], nxt[i] = r, False, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            for x, y in ((prv[i], i), (i, nxt[i])):
                if x >= 0 and y < n and (q := self.pair.get(ids[x] << 20 | ids[y])) is not None:
                    heapq.heappush(heap, (q, x, ids[x], ids[y]))
        return np.array([x for x, ok in zip(ids, live, strict=True) if ok], "<u4").tobytes()

    def _encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        out: dict[bytes, bytes] = {}
        by: dict[int, list[bytes]] = {}
        raw = [p.encode() for p in pieces]
        for b in set(raw):
            if (r := self.ranks.get(b)) is not None:
                out[b] = r.to_bytes(4, "little")
            elif len(b) > LONG:
                out[b] = self._heap(b)
            else:
                by.setdefault((len(b) + 1) // 2 if len(b) < 24 else 100 + len(b).bit_length(), []).append(b)
        for rows in by.values():
            step = max(64, 400_000 // max(map(len, rows)))
            for i in range(0, len(rows), step):
                self._matrix(rows[i : i + step], out)
        return dict(zip(pieces, map(out.__getitem__, raw), strict=True))

    def _pieces(self, pieces: set[str]) -> None:
        new = pieces - self.pieces.keys()
        if len(self.pieces) + len(new) > CACHE // 2:
            self.pieces.clear()
            new = pieces
        self.pieces.update(self._encode_pieces(list(new)))

    def _learn(self, parts: set[str]) -> None:
        """Encode parts that are not cached. A part whose leading space is followed by white space or nothing depends on its
        neighbours: it gets None, and texts that hold it are matched as a whole."""
        plain, cut = [], {}
        for p in parts:
            body = p[1:] if p[:1] == " " else p
            if not body or (p is not body and body[0].isspace()):
                self.parts[p] = None
            elif body.isalpha() and (body.isascii() or max(body) < "\u0250"):
                plain.append(p)
            else:
                cut[p] = self.find(p)
        self.parts.update(self._encode_pieces(plain))
        self._pieces({x for found in cut.values() for x in found})
        get = self.pieces.__getitem__
        for p, found in cut.items():
            self.parts[p] = b"".join(map(get, found))

    # ---- texts
    def _whole(self, text: str) -> bytes:
        found = self.find(text)
        out = []
        for i in range(0, len(found), 100_000):
            self._pieces(set(found[i : i + 100_000]))
            out.append(b"".join(map(self.pieces.__getitem__, found[i : i + 100_000])))
        return b"".join(out)

    def encode_packed(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        i = 0
        while i < len(texts):  # a few texts at a time, so that the cache's bound holds
            cut, n = [], 0
            while i < len(texts) and n < 200_000:
                first, *rest = (texts[i] or "").split(" ")
                cut.append([first, *[" " + x for x in rest]] if first else [" " + x for x in rest])
                n += len(rest) + 1
                i += 1
            missing = set().union(*cut) - self.parts.keys()
            if len(self.parts) + len(missing) > CACHE and self.parts:
                self.parts.clear()
                missing = set().union(*cut)
            self._learn(missing)
            get = self.parts.__getitem__
            for k, parts in enumerate(cut, i - len(cut)):
                try:
                    out.append(b"".join(map(get, parts)))
                except TypeError:
                    out.append(self._whole(texts[k]))
        return out

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_packed([text])[0], "<u4").tolist()

    def decode_packed(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.tokens[i] for i in ids)


_MADE: dict[int, ByteBPE] = {}


def _coder(vocabulary: bytes, pattern: str) -> ByteBPE:
    """One per Python worker: building the pair table takes a second, and the caches stay warm between tasks."""
    key = hash((vocabulary, pattern))
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = ByteBPE(vocabulary, pattern)
    return _MADE[key]


def read_vocabulary(path: str) -> bytes:
    """Read on the driver; the content (below 1 MB) goes to the workers with the function, so they need no such file."""
    with open(path, "rb") as f:
        return f.read()


def encode(df: DataFrame, vocabulary: bytes, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>): the ids of each whole text; null text: an empty array."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        coder = _coder(vocabulary, pattern)
        for batch in batches:
            for b in slices(batch):
                got = [np.frombuffer(x, "<u4").astype(np.int32) for x in coder.encode_packed(b.column(1).to_pylist())]
                ends = np.cumsum([0, *map(len, got)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(got) if got else []))], [key, "ids"])

    return small_batches(df).select(key, df[text].alias("text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode(df: DataFrame, vocabulary: bytes, pattern: str, key: str = "doc_id") -> DataFrame:
    """(key, bytes binary) of (key, ids); null ids: empty."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        coder = _coder(vocabulary, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([coder.decode(x or []) for x in b.column(1).to_pylist()], pa.binary())], [key, "bytes"])

    return df.select(key, "ids").mapInArrow(run, f"`{key}` {kind}, bytes binary")


def digests(df: DataFrame, vocabulary: bytes, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, decode the ids again, and keep the digests of both, all in one pass over the texts (no shuffle)."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        coder = _coder(vocabulary, pattern)
        sha = hashlib.sha256
        for batch in batches:
            for b in slices(batch):
                packed = coder.encode_packed(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array([sha(x).hexdigest() for x in packed]), pa.array([sha(coder.decode_packed(x)).hexdigest() for x in packed])],
                    [key, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return small_batches(df).select(key, df[text].alias("text")).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
