"""Byte-level BPE encoding and decoding.

Texts are split by a pattern; the distinct new pre-tokens of an Arrow batch are put into padded
matrices by length. In each round every row merges its leftmost pair of least rank: ranks come
from a hashed pair table, merged cells are closed up by compaction, finished rows leave. Spark
deals the documents; each task keeps only a bounded table of encoded pre-tokens.

Defined cases: a null or empty text has no ids; a pre-token of any length is encoded whole (those
of over LONGEST bytes by a heap over the same pair table); repeated rows each return a row; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

LONGEST = 64
WIDTHS = (4, 8, 12, 16, 24, 32, 48, LONGEST)
CACHE = 100_000
#: Rows of a padded matrix.
ROWS = 5_000
NONE = np.int64(1 << 40)


class Ranks:
    """A rank file as arrays: the token of each id and an open-addressed table of mergeable pairs."""

    def __init__(self, path: str):
        self.tokens: list[bytes] = []
        self.of: dict[bytes, int] = {}
        with open(path, "rb") as lines:
            for line in lines:
                token, rank = line.split()
                self.of[base64.b64decode(token)] = int(rank)
        self.token = {rank: token for token, rank in self.of.items()}
        self.byte = np.array([self.of[bytes([b])] for b in range(256)], dtype=np.int64)
        keys, ranks = [], []
        of = self.of
        for token, rank in of.items():
            for cut in range(1, len(token)):
                a, b = of.get(token[:cut]), of.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 20 | b)
                    ranks.append(rank)
        self.bits = max(10, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << self.bits, NONE, dtype=np.int64)
        left, value = np.array(keys, dtype=np.int64), np.array(ranks, dtype=np.int64)
        slot = self._slot(left)
        while len(left):
            empty = self.keys[slot] == -1
            self.keys[slot[empty]] = left[empty]
            won = self.keys[slot] == left
            self.ranks[slot[won]] = value[won]
            left, value, slot = left[~won], value[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where the two don't merge."""
        keys = a << 20 | b
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.ranks[slot], NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece."""
        out: list[list[int] | None] = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.of.get(piece)
            if whole is not None:
                out[i] = [whole]
            elif len(piece) > LONGEST:
                out[i] = self.encode_long(piece)
            elif piece:
                buckets.setdefault(next(w for w in WIDTHS if w >= len(piece)), []).append(i)
            else:
                out[i] = []
        for width, rows in buckets.items():
            for at in range(0, len(rows), ROWS):
                self._rounds(pieces, rows[at : at + ROWS], width, out)
        return out

    def _rounds(self, pieces: list[bytes], rows: list[int], width: int, out: list) -> None:
        size = np.array([len(pieces[i]) for i in rows])
        raw = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in rows), dtype=np.uint8).reshape(len(rows), width)
        ids, row = self.byte[raw], np.array(rows)
        cols = np.arange(width)
        rank = np.full((len(rows), width), NONE, dtype=np.int64)
        live = cols[:-1] < (size - 1)[:, None]
        a, b = ids[:, :-1][live], ids[:, 1:][live]
        rank[:, :-1][live] = self.pairs(a, b)
        while len(row):
            at = rank.argmin(axis=1)
            here = np.arange(len(row))
            best = rank[here, at]
            done = best == NONE
            if done.any():
                for i in np.flatnonzero(done):
                    out[row[i]] = ids[i, : size[i]].tolist()
                keep = ~done
                ids, rank, size, row, at, best = ids[keep], rank[keep], size[keep], row[keep], at[keep], best[keep]
                if not len(row):
                    return
                here = np.arange(len(row))
            ids[here, at] = best
            after = cols[None, :-1] > at[:, None]
            ids[:, :-1] = np.where(after, ids[:, 1:], ids[:, :-1])
            rank[:, :-1] = np.where(after, rank[:, 1:], rank[:, :-1])
            rank[:, -1] = NONE
            size -= 1
            rank[here, at] = NONE
            right = at < size - 1
            rank[here[right], at[right]] = self.pairs(best[right], ids[here[right], at[right] + 1])
            left = at > 0
            rank[here[left], at[left] - 1] = self.pairs(ids[here[left], at[left] - 1], best[left])

    def encode_long(self, piece: bytes) -> list[int]:
        """One piece by a heap of (rank, position) over a linked list: n log n for any length."""
        ids = self.byte[np.frombuffer(piece, dtype=np.uint8)]
        first = self.pairs(ids[:-1], ids[1:])
        ids = ids.tolist()
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(int(first[i]), i, ids[i], ids[i + 1]) for i in np.flatnonzero(first != NONE)]
        heapq.heapify(heap)
        rank = lambda a, b: int(self.pairs(np.array([a]), np.array([b]))[0])
        while heap:
            best, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = best, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := rank(best, ids[after[i]])) != NONE:
                    heapq.heappush(heap, (r, i, best, ids[after[i]]))
            if (h := before[i]) >= 0 and (r := rank(ids[h], best)) != NONE:
                heapq.heappush(heap, (r, h, ids[h], best))
        return [x for x in ids if x >= 0]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


_loaded: dict[str, Ranks] = {}


def load(path: str) -> Ranks:
    """The rank file, once per Python worker."""
    if path not in _loaded:
        _loaded[path] = Ranks(path)
    return _loaded[path]


class Encoder:
    """Encodes texts with a bounded table of pre-tokens: text, number of ids and decoded bytes of each."""

    def __init__(self, path: str, pattern: str):
        self.ranks, self.split = load(path), regex.compile(pattern).findall
        self.known: dict[str, tuple[int, str, bytes]] = {}

    def learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > CACHE:
            self.known = {p: self.known[p] for p in pieces if p in self.known}
        for piece, ids in zip(new, self.ranks.encode([p.encode() for p in new]), strict=True):
            self.known[piece] = (len(ids), ",".join(map(str, ids)), self.ranks.decode(ids))

    def ids(self, text: str) -> list[int]:
        pieces = self.split(text or "")
        self.learn(set(pieces))
        return [int(x) for p in pieces for x in self.known[p][1].split(",")]


#: Characters of texts that are split at once.
GROUP_CHARS = 1_000_000


def _groups(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[str]]]:
    """The batch's texts in groups of bounded size: (number of the first row, texts)."""
    group, chars, start = [], 0, 0
    for i, value in enumerate(batch.column(column)):
        text = value.as_py() or ""
        group.append(text)
        chars += len(text)
        if chars > GROUP_CHARS:
            yield start, group
            group, chars, start = [], 0, i + 1
    if group:
        yield start, group


def encode(docs: DataFrame, ranks: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """Per document: doc_id, n_tokens, ids (array, if with_ids), ids_sha256 and decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks, pattern)
        for batch in batches:
            for start, texts in _groups(batch, "text"):
                split = [encoder.split(t) for t in texts]
                encoder.learn(set().union(*split))
                known = encoder.known
                n, idsum, decoded, ids = [], [], [], []
                for pieces in split:
                    found = [known[p] for p in pieces]
                    n.append(sum(f[0] for f in found))
                    joined = ",".join([f[1] for f in found])
                    idsum.append(hashlib.sha256(joined.encode()).hexdigest())
                    decoded.append(hashlib.sha256(b"".join([f[2] for f in found])).hexdigest())
                    if with_ids:
                        ids.append(np.array(joined.split(","), dtype=np.int32) if joined else np.array([], dtype=np.int32))
                columns = {"doc_id": batch.column("doc_id").slice(start, len(texts)), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(idsum, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
                if with_ids:
                    columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """Per row of (doc_id, ids): doc_id and text, the decoded bytes as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = load(ranks)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array([table.decode(x.as_py() or []) for x in batch.column("ids")], pa.binary())})

    kind = dict(encoded.select("doc_id").dtypes)["doc_id"]
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text binary")
