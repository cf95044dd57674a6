"""Scores of texts by a bigram model held in Elias-Fano tries.

The model is interpolated absolute discounting over the add-one unigram base:

    p(w | v) = max(c(vw) - D, 0) / c(v) + D * T(v) / c(v) * p(w),  p(w) = (c(w) + 1) / (N + V + 1)

with T(v) the number of different successors of v, and p(w) alone where v was never seen. A text
is its words between two boundaries; the boundary after it is its end token.

Tokens are kept in batches of documents. A batch sends its distinct contexts with their distinct
successors and training counts, once each, in one row per shard of context hashes that it has any in:
never more rows than it has different words, whatever the size of the corpus. A shard holds about
SHARD_TOKENS training tokens. Its task adds up the counts and builds its trie: level 1 has the
contexts with counts, level 2 their successors with quantised discounted probabilities. A successor
is numbered relative to its context, by its place among the successors that are asked for there. Both
levels and the pointers between them are Elias-Fano coded monotone sequences in one memory-mapped
file. Questions are answered by successor search in the range that the context's pointers give; the
pointers also give the number of different successors. The batch puts the answers back to its tokens.
So counts are exact over the whole training corpus, a model of any size is spread over the tasks, and
nothing goes through the driver but two sums and the hot words.

A context of more training tokens than a shard is meant for is dealt by its successors into shards of
its own. These hot words are HOT at most, as a shard is meant for no fewer than that part of all tokens.

Words are told apart by 64 bits of hash, the successors of one context by 48. Defined cases: a null or
empty text is its end token alone; a null doc_id is training data (it has no checksum); repeated rows
count and return as often as they stand; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketweave.llm.common import cut, saved

DISCOUNT = 0.75
#: Characters of a batch of documents; training tokens that a shard is meant for; words that are hot at most.
BATCH_CHARS, SHARD_TOKENS, HOT = 10_000_000, 2_000_000, 1 << 20
#: Steps of log10 between the least and the greatest discounted count of a context.
STEPS = 254

_squeeze = zstandard.ZstdCompressor(level=1)
_expand = zstandard.ZstdDecompressor()


def pack(array: np.ndarray) -> bytes:
    return _squeeze.compress(np.ascontiguousarray(array).tobytes())


def unpack(data: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(_expand.decompress(data), dtype=dtype)


def _step(counts: np.ndarray) -> np.ndarray:
    return np.log10((np.maximum(counts, 1) - DISCOUNT) / (1 - DISCOUNT)) / STEPS


def quantise(bigrams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Codes 1..255 of bigram counts above 0 in contexts of so many tokens, and 0.

    1 is a bigram seen once, 255 one that fills its context; the steps between follow the context, so nothing is clipped.
    """
    above = np.log10((np.maximum(bigrams, 1) - DISCOUNT) / (1 - DISCOUNT))
    return np.where(bigrams > 0, np.rint(above / np.maximum(_step(counts), 1e-9)) + 1, 0).astype(np.uint8)


def probability(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Discounted probabilities of codes in contexts of so many tokens."""
    return np.where(codes > 0, (1 - DISCOUNT) * 10.0 ** (_step(counts) * (codes.astype(np.float64) - 1)) / np.maximum(counts, 1), 0.0)


class Monotone:
    """An Elias-Fano coded non-decreasing sequence, over arrays that may be memory-mapped."""

    NAMES = ("low", "high", "zeros")

    def __init__(self, size: int, bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.size, self.bits, self.low, self.high, self.zeros = size, bits, low, high, zeros

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> Monotone:
        values = values.astype(np.uint64)
        n = len(values)
        bits = max(0, (universe // max(1, n)).bit_length() - 1)
        low = np.zeros((n * bits + 63) // 64 + 1, dtype=np.uint64)
        if bits:
            raw = []
            for at in range(0, n, 65_536):  # 65,536 entries fill whole words
                part = values[at : at + 65_536] & np.uint64((1 << bits) - 1)
                table = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :bits]
                raw.append(np.packbits(table.ravel(), bitorder="little"))
            joined = np.concatenate(raw) if raw else np.zeros(0, np.uint8)
            low.view(np.uint8)[: len(joined)] = joined
        # element i sets the bit at (its high part) + i; a zero ends each high part
        place = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        length = (universe >> bits) + n + 2
        flags = np.zeros((length + 63) // 64 * 64, dtype=np.uint8)
        flags[place] = 1
        high = np.packbits(flags, bitorder="little").view("<u8")
        ones = np.bitwise_count(high).astype(np.int64)
        zeros = np.concatenate([[0], np.cumsum(64 - ones)]).astype(np.uint32)
        return cls(n, bits, low, high, zeros)

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), dtype=np.uint64)
        bit = i.astype(np.int64) * self.bits
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        up = np.where(shift == 0, np.uint64(0), self.low[np.minimum(word + 1, len(self.low) - 1)] << ((np.uint64(64) - shift) & np.uint64(63)))
        return (self.low[word] >> shift | up) & np.uint64((1 << self.bits) - 1)

    def select_zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the zero of rank k (from 0)."""
        word = np.searchsorted(self.zeros, k, side="right") - 1
        left = (k - self.zeros[word]).astype(np.int64)
        x = ~self.high[word]
        at = np.zeros(len(k), dtype=np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count(x & np.uint64((1 << width) - 1)).astype(np.int64)
            beyond = left >= count
            left -= np.where(beyond, count, 0)
            x = np.where(beyond, x >> np.uint64(width), x)
            at += np.where(beyond, width, 0)
        return word * 64 + at

    def find(self, values: np.ndarray) -> np.ndarray:
        """Position of each value, -1 where the sequence lacks it: successor search in its high part."""
        values = values.astype(np.uint64)
        high = (values >> np.uint64(self.bits)).astype(np.int64)
        low = values & np.uint64((1 << self.bits) - 1)
        place = np.where(high == 0, 0, self.select_zero(np.maximum(high - 1, 0)) + 1)
        out = np.full(len(values), -1, dtype=np.int64)
        open_ = np.arange(len(values))
        while len(open_) and self.size:
            at = place[open_]
            inside = (self.high[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            open_, at = open_[inside], at[inside]
            i = at - high[open_]
            found = self.lows(i)
            hit = found == low[open_]
            out[open_[hit]] = i[hit]
            open_ = open_[found < low[open_]]
            place[open_] += 1
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at positions i."""
        ones = (np.arange(len(self.zeros)) * 64 - self.zeros.astype(np.int64))
        word = np.searchsorted(ones, i, side="right") - 1
        left = i - ones[word]
        x = self.high[word].copy()
        at = np.zeros(len(i), dtype=np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count(x & np.uint64((1 << width) - 1)).astype(np.int64)
            beyond = left >= count
            left -= np.where(beyond, count, 0)
            x = np.where(beyond, x >> np.uint64(width), x)
            at += np.where(beyond, width, 0)
        return (word * 64 + at - i).astype(np.uint64) << np.uint64(self.bits) | self.lows(i)


class Trie:
    """Two levels in one memory-mapped file: contexts with counts, successors with probabilities."""

    def __init__(self, contexts: np.ndarray, counts: np.ndarray, numbered: np.ndarray, owner: np.ndarray, successors: np.ndarray, bigrams: np.ndarray):
        """contexts: sorted hashes; numbered: how many successors are numbered in each; owner: place of each bigram's context, sorted; successors: numbers in it, sorted."""
        self.base = contexts[0] if len(contexts) else np.uint64(0)
        bounds = np.concatenate([[0], np.cumsum(numbered)])
        first = Monotone.encode(contexts - self.base, int(contexts[-1] - self.base) + 1 if len(contexts) else 1)
        pointers = Monotone.encode(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(contexts)))]), len(owner) + 1)
        ranges = Monotone.encode(bounds, int(bounds[-1]) + 1)
        second = Monotone.encode(bounds[owner] + successors, int(bounds[-1]) + 1)
        parts = [x for m in (first, pointers, ranges, second) for x in (m.low, m.high, m.zeros)] + [counts.astype(np.int64), quantise(bigrams, counts[owner])]
        with tempfile.NamedTemporaryFile(suffix=".trie", delete=False) as out:
            self.path = out.name
            for x in parts:
                out.write(x.tobytes())
                out.write(bytes(-x.nbytes % 8))
        mapped = []
        at = 0
        for x in parts:
            mapped.append(np.memmap(self.path, dtype=x.dtype, mode="r", offset=at, shape=x.shape) if x.size else x)
            at += x.nbytes + -x.nbytes % 8
        # the file goes with the last mapping of it, also where a task dies
        os.unlink(self.path)
        self.first, self.pointers, self.ranges, self.second = (Monotone(m.size, m.bits, *mapped[3 * i : 3 * i + 3]) for i, m in enumerate((first, pointers, ranges, second)))
        self.counts, self.probability = mapped[12:]

    def contexts(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position (-1: unknown), count and number of successors of each context."""
        if not self.first.size:
            return np.full(len(hashes), -1), np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        inside = (hashes >= self.base) & (hashes - self.base <= self.first.get(np.array([self.first.size - 1]))[0])
        at = np.where(inside, self.first.find(np.where(inside, hashes - self.base, np.uint64(0))), -1)
        known = np.maximum(at, 0)
        kinds = (self.pointers.get(known + 1) - self.pointers.get(known)).astype(np.int64)
        return at, np.where(at >= 0, self.counts[known], 0), np.where(at >= 0, kinds, 0)

    def codes(self, at: np.ndarray, successors: np.ndarray) -> np.ndarray:
        """Code of each bigram (context position, number of the successor in it), 0 where it was never seen."""
        out = np.zeros(len(at), dtype=np.uint8)
        known = np.flatnonzero(at >= 0)
        place = self.second.find(self.ranges.get(at[known]) + successors[known].astype(np.uint64))
        within = (place >= self.pointers.get(at[known]).astype(np.int64)) & (place < self.pointers.get(at[known] + 1).astype(np.int64))
        out[known[within]] = self.probability[place[within]]
        return out


def held_out(column: str = "doc_id", parts: int = 7, part: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string")) % parts == part, F.lit(False))


_BATCHES = "batch long, n long, ids binary, missing binary, train binary, sizes binary, words binary, tokens binary"


def batches_of(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text, train) as rows of packed tokens, one per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        chars = 0

        def settle() -> pa.RecordBatch:
            nonlocal number
            texts = [(t or "").encode().lower().split() for _, t, _ in rows]
            name = {w: xxhash.xxh64_intdigest(w) | 1 for w in set().union(*texts)}  # 0 is the boundary
            flat = np.array([name[w] for t in texts for w in t], dtype=np.uint64)
            words, tokens = np.unique(np.append(flat, np.uint64(0)), return_inverse=True)
            number += 1
            return pa.RecordBatch.from_pydict({
                "batch": [number],
                "n": [len(flat) + len(rows)],
                "ids": [pack(np.array([0 if i is None else i for i, _, _ in rows], dtype=np.int64))],
                "missing": [pack(np.array([i is None for i, _, _ in rows], dtype=bool))],
                "train": [pack(np.array([t for _, _, t in rows], dtype=bool))],
                "sizes": [pack(np.array([len(t) for t in texts], dtype=np.int32))],
                "words": [pack(np.diff(words, prepend=np.uint64(0)))],
                "tokens": [pack(tokens[:-1].astype(np.int32).view(np.uint8).reshape(-1, 4).T)],
            })

        for batch in batches:
            for i, t, y in zip(*(batch.column(c) for c in ("doc_id", "text", "train")), strict=True):
                rows.append((i.as_py(), t.as_py(), y.as_py()))
                chars += len(rows[-1][1] or "")
                if chars >= BATCH_CHARS or len(rows) >= 100_000:
                    yield settle()
                    rows, chars = [], 0
        if rows:
            yield settle()

    return docs.select("doc_id", "text", "train").mapInArrow(run, _BATCHES)


class Batch:
    """A row of batches_of, with its distinct bigrams in the order in which they are asked for."""

    def __init__(self, row: dict):
        self.ids, self.missing = unpack(row["ids"], "i8"), unpack(row["missing"], "?")
        self.train, self.sizes = unpack(row["train"], "?"), unpack(row["sizes"], "i4")
        tokens = unpack(row["tokens"], "u1").reshape(4, -1).T.copy().view("i4").ravel()
        self.ends = np.cumsum(self.sizes + 1)  # place of each document's end, after the first boundary
        line = np.zeros(len(tokens) + len(self.sizes) + 1, dtype=np.int64)
        inside = np.ones(len(line), dtype=bool)
        inside[0] = inside[self.ends] = False
        line[inside] = tokens
        self.left, self.right = line[:-1], line[1:]
        self.pairs, self.inverse = np.unique(self.left << 32 | self.right, return_inverse=True)
        self.owner, self.successor = self.pairs >> 32, self.pairs & 0xFFFFFFFF


_ROWS = "shard long, part int, batch long, contexts binary, counts binary, sizes binary, names binary, pairs binary"
_ANSWERS = "batch long, shard long, part int, counts binary, kinds binary, codes binary"


def _pack_names(names: np.ndarray) -> bytes:
    """The upper 48 bits of each, byte by byte."""
    return pack(np.ascontiguousarray(names >> np.uint64(16)).view(np.uint8).reshape(-1, 8).T[:6])


def _unpack_names(data: bytes) -> np.ndarray:
    rows = unpack(data, "u1").reshape(6, -1)
    out = np.zeros((rows.shape[1], 8), dtype=np.uint8)
    out[:, :6] = rows.T
    return out.view(np.uint64).ravel()


def _asked(batches: DataFrame, bits: int, hot: np.ndarray, many: np.ndarray) -> DataFrame:
    """Rows of a batch: its contexts of a shard (part -1), or of a hot word (the shard) the successors of one part.

    hot: sorted hashes; many: parts of each. Contexts and successors stand in unsigned order of their hashes.
    """

    def run(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in records:
            for row in record.to_pylist():
                b = Batch(row)
                words = np.cumsum(unpack(row["words"], "u8"))
                weight = np.repeat(b.train, b.sizes + 1)
                counts = np.bincount(b.left, weight, len(words)).astype(np.uint32)
                pairs = np.bincount(b.inverse, weight, len(b.pairs)).astype(np.uint32)
                starts = np.searchsorted(b.owner, np.arange(len(words) + 1))
                names = words[b.successor]
                special = np.isin(words, hot)
                shard = (words >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(words), dtype=np.int64)
                out = []

                def send(to: int, part: int, own: np.ndarray, take: np.ndarray, sizes: np.ndarray) -> None:
                    out.append((to, part, row["batch"], pack(np.diff(words[own], prepend=np.uint64(0))), pack(counts[own]), pack(sizes.astype(np.int32)), _pack_names(names[take]), pack(pairs[take])))

                plain = np.flatnonzero(~special)
                edges = np.flatnonzero(np.concatenate([[True], shard[plain[1:]] != shard[plain[:-1]]])) if len(plain) else np.zeros(0, dtype=int)
                for own in np.split(plain, edges[1:]):
                    if len(own):
                        take = np.arange(starts[own[0]], starts[own[-1] + 1])
                        send(int(shard[own[0]]), -1, own, take[~special[b.owner[take]]], starts[own + 1] - starts[own])
                for v in np.flatnonzero(special):
                    parts = int(many[np.searchsorted(hot, words[v])])
                    part = (names[starts[v] : starts[v + 1]] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
                    for s in range(parts):
                        take = starts[v] + np.flatnonzero(part == s)
                        send(int(words[v].view(np.int64)), s, np.array([v]), take, np.array([len(take)]))
                kinds = (pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 5)
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=["shard", "part", "batch", "contexts", "counts", "sizes", "names", "pairs"])

    return batches.select("batch", "ids", "missing", "train", "sizes", "words", "tokens").mapInArrow(run, _ROWS)


def _settled(rows: list[dict]) -> Iterator[tuple]:
    """The answers to the rows of one shard, or of one part of a hot word."""
    contexts = [np.cumsum(unpack(r["contexts"], "u8")) for r in rows]
    names = [_unpack_names(r["names"]) for r in rows]
    every, of = np.unique(np.concatenate(contexts), return_inverse=True)
    total = np.bincount(of, np.concatenate([unpack(r["counts"], "u4") for r in rows])).astype(np.int64)
    owner = np.repeat(of, np.concatenate([unpack(r["sizes"], "i4") for r in rows]))
    flat = np.concatenate(names)
    order = np.lexsort((flat, owner))
    sorted_names, sorted_owner = flat[order], owner[order]
    fresh = np.concatenate([[True], (sorted_names[1:] != sorted_names[:-1]) | (sorted_owner[1:] != sorted_owner[:-1])])[: len(order)]
    back = np.empty(len(order), dtype=np.int64)
    back[order] = np.cumsum(fresh) - 1
    bigrams = np.bincount(back, np.concatenate([unpack(r["pairs"], "u4") for r in rows]), int(fresh.sum())).astype(np.int64)
    # successors are numbered in their context; the trie holds what training has seen
    asked = sorted_owner[fresh]
    numbered = np.bincount(asked, minlength=len(every))
    number = np.arange(len(asked)) - (np.cumsum(numbered) - numbered)[asked]
    seen, kept = total > 0, bigrams > 0
    position = np.cumsum(seen) - 1
    trie = Trie(every[seen], total[seen], numbered[seen], position[asked[kept]], number[kept], bigrams[kept])
    at, count, kinds = trie.contexts(every)
    code = trie.codes(at[asked], number)[back]
    i = j = 0
    for r, own, mine in zip(rows, contexts, names, strict=True):
        place = of[i : i + len(own)]
        yield r["batch"], r["shard"], r["part"], pack(count[place]), pack(kinds[place]), pack(code[j : j + len(mine)])
        i, j = i + len(own), j + len(mine)


def _answered(rows: DataFrame) -> DataFrame:
    """Per row: the contexts' training counts, the numbers of their different successors (of the part), and a code per name."""

    def run(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        kinds = (pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 3)

        def settle() -> pa.RecordBatch:
            out = list(_settled(held))
            return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=["batch", "shard", "part", "counts", "kinds", "codes"])

        for record in records:
            for row in record.to_pylist():
                if held and (held[0]["shard"], held[0]["part"]) != (row["shard"], row["part"]):
                    yield settle()
                    held = []
                held.append(row)
        if held:
            yield settle()

    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ready = rows.repartition(count, "shard", "part").sortWithinPartitions("shard", "part")
    return ready.mapInArrow(run, _ANSWERS)


def _score(batches: DataFrame, answers: DataFrame, n: int, v: int) -> DataFrame:
    def run(key: tuple, own: pa.Table, replies: pa.Table) -> pa.Table:
        row = own.to_pylist()[0]
        b = Batch(row)
        words = np.cumsum(unpack(row["words"], "u8"))
        told = sorted(replies.to_pylist(), key=lambda r: (r["part"] >= 0, r["shard"] % (1 << 64), r["part"]))
        plain = [r for r in told if r["part"] < 0]
        parts: dict[int, list[dict]] = {}
        for r in told[len(plain) :]:
            parts.setdefault(r["shard"] % (1 << 64), []).append(r)
        special = np.isin(words, np.array(list(parts), dtype=np.uint64))
        joined = lambda rows, c, t: np.concatenate([unpack(r[c], t) for r in rows]) if rows else np.zeros(0, t)
        count, kind, code = np.zeros(len(words)), np.zeros(len(words)), np.zeros(len(b.pairs), dtype=np.uint8)
        count[~special], kind[~special] = joined(plain, "counts", "i8"), joined(plain, "kinds", "i8")
        code[~special[b.owner]] = joined(plain, "codes", "u1")
        for word, rows in parts.items():
            at = int(np.searchsorted(words, np.uint64(word)))
            count[at], kind[at] = unpack(rows[0]["counts"], "i8")[0], joined(rows, "kinds", "i8").sum()
            code[slice(*np.searchsorted(b.owner, [at, at + 1]))] = joined(rows, "codes", "u1")
        base = np.log10((count + 1) / (n + v + 1))
        seen = count[b.owner] > 0
        share = np.where(seen, DISCOUNT * kind[b.owner] / np.maximum(count[b.owner], 1), 1.0)
        p = np.log10(probability(code, count[b.owner]) + share * 10.0 ** base[b.successor])
        starts = b.ends - b.sizes - 1
        whole = lambda x: np.add.reduceat(x, starts)
        return pa.table({
            "doc_id": pa.array(b.ids, pa.int64(), mask=b.missing),
            "held_out": pa.array(~b.train),
            "n_tokens": pa.array((b.sizes + 1).astype(np.int64)),
            "n_known": pa.array(whole((count[b.right] > 0).astype(np.int64))),
            "train_tokens": pa.array(np.full(len(b.ids), n, dtype=np.int64)),
            "base_score": pa.array(whole(base[b.right])),
            "score": pa.array(whole(p[b.inverse])),
        })

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    left = batches.select("batch", "ids", "missing", "train", "sizes", "words", "tokens")
    return left.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(run, schema)


def _words(batches: DataFrame) -> DataFrame:
    """(context, n): training tokens of each word, with the end of texts as 0."""

    def run(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in records:
            for row in record.to_pylist():
                sizes, train = unpack(row["sizes"], "i4"), unpack(row["train"], "?")
                tokens = unpack(row["tokens"], "u1").reshape(4, -1).T.copy().view("i4").ravel()
                words = np.cumsum(unpack(row["words"], "u8"))
                n = np.bincount(tokens, np.repeat(train, sizes), len(words)).astype(np.int64)
                n[0] = train.sum()
                yield pa.RecordBatch.from_pydict({"context": words.view(np.int64)[n > 0], "n": n[n > 0]})

    return batches.select("train", "sizes", "words", "tokens").mapInArrow(run, "context long, n long").groupBy("context").agg(F.sum("n").alias("n"))


def score(docs: DataFrame, held_out: Column | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Per document of (doc_id, text): held_out, n_tokens, n_known, train_tokens, base_score and score.

    Documents with held_out true are scored and not learned from.
    """
    train = ~F.coalesce(held_out, F.lit(False)) if held_out is not None else F.lit(True)
    batches = cut(batches_of(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", train.alias("train"))))
    words = saved(_words(batches))
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    size = max(shard_tokens, -(-sums.n // HOT))
    bits = max(0, (int(sums.n) // size).bit_length())
    found = sorted((r.context % (1 << 64), -(-r.n // size)) for r in words.where(F.col("n") > size).collect())  # HOT at most
    hot, many = np.array([x for x, _ in found], dtype=np.uint64), np.array([x for _, x in found], dtype=np.int64)
    return _score(batches, _answered(_asked(batches, bits, hot, many)), sums.n, sums.v)
