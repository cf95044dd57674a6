"""Passages that occur again anywhere in the corpus, found in enhanced suffix arrays.

Two equal strings of LEAST bytes have the same least gram: of their GRAM-byte grams the one of
least hash, the rightmost of equals. So every window of LEAST bytes is owned by its least gram
(its anchor), and equal windows meet under equal anchors at equal offsets. An anchor's region is
the bytes of all windows that it owns in its document, and on to LENGTH bytes from the last.

1. Regions that are equal are one string with all its occurrences; that string is a repeat as a
   whole, of which no array can tell more.
2. The different regions of a gram are put into one suffix array, made by prefix doubling. A stack
   scan over its longest common prefixes gives the intervals of suffixes that share LEAST bytes or
   more; those whose occurrences are preceded by different bytes are the maximal repeats, with all
   their occurrences.
3. A gram of over BUCKET different regions is split further before that: its windows are taken in
   blocks of consecutive offsets, and regions go on together only where they agree in the bytes that
   all windows of the block hold. Equal parts become one string again, and what is still too large is
   split by smaller blocks, down to single windows. So an array has BUCKET regions at most, whatever
   the gram.

Repeats of LENGTH bytes or more are joined per document and cut out. Shorter ones, of LEAST bytes or
more, are counted beside where they are asked for; else LEAST is LENGTH.

Passages of so many words that occur again can be counted too, however few bytes they have. They go the
same way with hashes of words for bytes: anchors are grams of words, regions are runs of words, equal
regions are one string, and windows of so many words are matched between the different regions of a gram.
Words are told apart by 64 bits of hash, in windows by 32 a word.

Defined cases: a null text is empty; a text shorter than LENGTH bytes keeps all its bytes; equal
rows are copies of each other; matches never cross documents; an empty table gives an empty
result; further columns are ignored. Equality of regions is judged by 64 bits of hash beside the
64 of the gram.
"""

from __future__ import annotations

import functools
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketweave.llm.common import saved, text_of

LENGTH, GRAM = 400, 32
#: Words of a gram of words; bytes of a word's code in regions of words.
WORD_GRAM, CODE = 8, 4
#: Different regions of a gram that meet in one array; offsets of the blocks by which larger ones are split.
BUCKET, BLOCKS = 256, (64, 8, 1)
#: Bytes of texts that a task hashes at once, and of regions that share a suffix array.
CHUNK, ARRAY = 4_000_000, 400_000
#: Symbols of 9 bits (byte + 1, or 0 beyond the end) in a word of the first sort.
SYMBOLS = 7
_rng = np.random.default_rng(17)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = _rng.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = 28
_WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LETTER = np.where(_WHITE, np.uint64(0), _BYTE)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def rolling(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` values from each position, by doubling; size - 1 positions short at the end."""
    out, have, parts = values, 1, []
    left, step = size, 0
    while True:
        if left & 1:
            parts.append((have, out))
        left >>= 1
        if not left:
            break
        out = out[:-have] * _STEPS[step] + out[have:] if len(out) > have else out[:0]
        have, step = have * 2, step + 1
    total, at = None, 0
    for width, x in reversed(parts):
        n = max(0, len(values) - size + 1)
        piece = x[at : at + n]
        total = piece.copy() if total is None else total * _STEPS[-1] + piece
        at += width
    return _mix(total)


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each `width` consecutive ones."""
    n, have, out = len(values) - width + 1, 1, values
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[:n], out[width - have : width - have + n])


def anchors(values: np.ndarray, least_: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor, first and last owned window start, gram hash) of the anchors of one run of values of bytes or words."""
    hashes = rolling(values, gram)
    rank = (hashes >> np.uint64(_PLACE)) << np.uint64(_PLACE) | (np.uint64((1 << _PLACE) - 1) - np.arange(len(hashes), dtype=np.uint64))
    low = least(rank, least_ - gram + 1)
    at = (np.uint64((1 << _PLACE) - 1) - (low & np.uint64((1 << _PLACE) - 1))).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.append(first[1:], len(at)) - 1
    return at[first], first, last, hashes[at[first]]


@functools.lru_cache(1)
def _table_of_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = int(_STEPS[0])
    return tuple(np.cumprod(np.full(n, x, dtype=np.uint64)) for x in (base, pow(base, -1, 1 << 64)))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, n at least, and what each is to be multiplied by to give 1."""
    have = 1 << 16
    while have < n:
        have *= 2
    return _table_of_powers(have)


def word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the words."""
    inside = np.concatenate([[False], ~_WHITE[np.frombuffer(raw, dtype=np.uint8)], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash of each word."""
    starts, stops = word_bounds(raw)
    data, out, at = np.frombuffer(raw, dtype=np.uint8), np.empty(len(starts), dtype=np.uint64), 0
    while at < len(starts):
        end = int(np.searchsorted(stops, starts[at] + CHUNK, side="right"))
        if end == at:  # a word of over CHUNK bytes
            out[at], at = xxhash.xxh3_64_intdigest(raw[starts[at] : stops[at]]), at + 1
            continue
        here = starts[at:end] - starts[at]
        power, inverse = _powers(int(stops[end - 1] - starts[at]))
        piece = _LETTER[data[starts[at] : stops[end - 1]]]
        out[at:end], at = _mix(np.add.reduceat(piece * power[: len(piece)], here) * inverse[here]), end
    return out


def _packed(start: np.ndarray, lead: np.ndarray, own: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A region's start, its anchor's offset, number of windows and length in one long."""
    return start.astype(np.int64) << 32 | lead.astype(np.int64) << 22 | own.astype(np.int64) << 12 | size.astype(np.int64)


def _start(place: Column) -> Column:
    return F.shiftright(place, 32)


def _size(place: Column) -> Column:
    return place.bitwiseAND(F.lit(0xFFF))


def occurrences(docs: DataFrame, length: int = LENGTH, least_: int = LENGTH, gram: int = GRAM, words: int | None = None) -> DataFrame:
    """(doc, gram, region, place, words): a row per anchor; region is a hash of the region's content and of the anchor's offset in it.

    words is true for regions of words, which are there if a number of words is given; their places are counted in words.
    """
    if not (gram <= least_ <= length and least_ < 1 << 10 and least_ + length < 1 << 12):
        raise ValueError("gram <= least_ <= length with least_ < 1024 and least_ + length < 4096 is asked for")
    if words is not None and not WORD_GRAM <= words < 1 << 9:
        raise ValueError(f"{WORD_GRAM} <= words < 512 is asked for")

    def of_words(raw: bytes) -> Iterator[tuple[np.ndarray, ...]]:
        hashes = word_hashes(raw)
        for at in range(0, max(1, len(hashes) - words + 1), CHUNK):
            part = hashes[at : at + CHUNK + words - 1]
            if len(part) < words:
                continue
            place, first, last, name = anchors(part, words, WORD_GRAM)
            power, inverse = _powers(len(part))
            sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(part * power[: len(part)])])
            own = last - first + 1
            region = _mix((sums[last + words] - sums[first]) * inverse[first]) ^ _mix((place - first << 10 | own).astype(np.uint64))
            yield _mix(name + np.uint64(words)).view(np.int64), region.view(np.int64), _packed(first + at, place - first, own, own + words - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "gram", "region", "place", "words"]
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in names]
            held = 0

            def put(key: int, columns: tuple[np.ndarray, ...], of_words: bool) -> int:
                for k, x in enumerate((np.full(len(columns[0]), key), *columns, np.full(len(columns[0]), of_words))):
                    out[k].append(x)
                return len(columns[0])

            for key, value in zip(batch.column("doc"), batch.column("text"), strict=True):
                raw = value.as_py().encode()
                for at in range(0, max(1, len(raw) - least_ + 1), CHUNK):
                    # runs overlap so that every window lies whole in one run, with what follows it
                    part = raw[at : at + CHUNK + least_ - 1]
                    if len(part) < least_:
                        continue
                    place, first, last, name = anchors(_BYTE[np.frombuffer(part, dtype=np.uint8)], least_, gram)
                    start = first + at
                    stop = np.minimum(last + at + length, len(raw))
                    region = np.array([xxhash.xxh3_64_intdigest(raw[s:e]) for s, e in zip(start.tolist(), stop.tolist(), strict=True)], dtype=np.uint64)
                    held += put(key.as_py(), (name.view(np.int64), (region ^ _mix((place - first).astype(np.uint64))).view(np.int64), _packed(start, place - first, last - first + 1, stop - start)), False)
                if words is not None and len(raw) >= 2 * words - 1:
                    for columns in of_words(raw):
                        held += put(key.as_py(), columns, True)
                if held > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=names)
                    out, held = [[] for _ in names], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=names)

    return docs.select("doc", "text").mapInArrow(run, "doc long, gram long, region long, place long, words boolean")


def suffix_array(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]], np.ndarray]:
    """Suffixes of the strings raw[start:stop], in order within equal values of group (ascending), by prefix doubling.

    Gives the positions in order, the ranks at each doubled length, and the end of each position's
    string. Positions of equal rank at a length agree in so many bytes, or to the ends of both.
    """
    sizes = stops - starts
    of = np.repeat(np.arange(len(starts)), sizes)
    at = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[of]
    end = np.zeros(len(raw) + 1, dtype=np.int64)
    end[at] = stops[of]
    word = np.zeros(len(at), dtype=np.uint64)
    for i in range(SYMBOLS):
        here = at + i
        word = word << np.uint64(9) | np.where(here < end[at], raw[np.minimum(here, len(raw) - 1)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    order = np.argsort(word, kind="stable")
    order = order[np.argsort(group[of[order]].astype(np.uint16 if len(starts) < 65_536 else np.int64), kind="stable")]
    own = group[of]
    new = np.concatenate([[True], (word[order[1:]] != word[order[:-1]]) | (own[order[1:]] != own[order[:-1]])])
    places = at[order]
    rank = np.zeros(len(raw) + 1, dtype=np.int64)
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    rank[places] = first + 1  # 0 is the rank beyond an end
    levels = [(SYMBOLS, rank.copy())]
    have, most = SYMBOLS, int(sizes.max()) if len(sizes) else 0
    # slots of the order whose class has more than one position
    open_ = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(open_) and have < most:
        p = places[open_]
        ahead = p + have
        second = np.where(ahead < end[p], rank[np.minimum(ahead, len(raw))], 0)
        key = rank[p] << 32 | second
        by = np.argsort(key, kind="stable")
        p, key = p[by], key[by]
        places[open_] = p
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[p] = np.maximum.accumulate(np.where(new, open_, 0)) + 1
        open_ = open_[~(new & np.append(new[1:], True))]
        have *= 2
        levels.append((have, rank.copy()))
    return places, levels, end


def common_prefixes(a: np.ndarray, b: np.ndarray, levels: list[tuple[int, np.ndarray]], end: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Bytes that the suffixes at a and at b have in common."""
    most = np.minimum(end[a] - a, end[b] - b)
    have = np.zeros(len(a), dtype=np.int64)
    for width, rank in reversed(levels):
        x, y = np.minimum(a + have, len(raw)), np.minimum(b + have, len(raw))
        have += np.where((have < most) & (rank[x] == rank[y]), width, 0)
    for _ in range(SYMBOLS - 1):
        x, y = np.minimum(a + have, len(raw) - 1), np.minimum(b + have, len(raw) - 1)
        have += (have < most) & (raw[x] == raw[y])
    return np.minimum(have, most)


def repeats(data: bytes, starts: np.ndarray, stops: np.ndarray, own: np.ndarray, group: np.ndarray, fixed: np.ndarray, length: int) -> Iterator[tuple[int, list[int]]]:
    """Maximal repeats of at least `length` bytes: (length, places) with all places of each.

    The strings are data[start:stop], each with `own` places at its beginning that may be places of
    a repeat; repeats are looked for within equal values of group, which ascend. fixed holds what a
    suffix at the beginning of a string counts as preceded by; values under 256 are bytes, others distinct.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    if not len(raw):
        return
    places, levels, end = suffix_array(raw, starts, stops, group)
    row = np.zeros(len(raw), dtype=np.int64)
    row[starts[1:]] = 1
    row = np.cumsum(row)
    # neighbours in order that can share so many bytes
    near = ([group[row]] + [rank for width, rank in levels if width <= length])[-1]
    close = np.flatnonzero(near[places[1:]] == near[places[:-1]])
    common = np.zeros(len(places) + 1, dtype=np.int64)
    common[close + 1] = common_prefixes(places[close], places[close + 1], levels, end, raw)
    common[common < length] = 0
    member = np.flatnonzero((common[:-1] > 0) | (common[1:] > 0))
    if not len(member):
        return
    # of places that aren't a string's own, the common prefix goes on to the next
    run = np.cumsum(common[member] == 0) - 1
    mine = places[member] - starts[row[places[member]]] < own[row[places[member]]]
    kept = np.flatnonzero(mine)
    if len(kept) < 2:
        return
    from_ = np.concatenate([[0], kept[:-1] + 1])
    low = np.minimum.reduceat(common[member][: kept[-1] + 1], from_)
    low[np.concatenate([[True], run[kept[1:]] != run[kept[:-1]]])] = 0
    place = places[member][kept]
    left = np.where(place == starts[row[place]], fixed[row[place]], raw[np.maximum(place - 1, 0)].astype(np.int64))
    # a run whose occurrences are all preceded by one byte is part of a longer repeat
    edge = np.flatnonzero(low == 0)
    bounds = np.append(edge[1:], len(place))
    diverse = np.minimum.reduceat(left, edge) != np.maximum.reduceat(left, edge)
    for a, b in zip(edge[diverse].tolist(), bounds[diverse].tolist(), strict=True):
        if b - a < 2:
            continue
        shared, before, names = low[a:b].tolist(), left[a:b].tolist(), place[a:b].tolist()
        # stack of open intervals (common prefix, first suffix, lowest and highest left byte)
        stack: list[list[int]] = []
        for i in range(len(names) + 1):
            now = shared[i] if 0 < i < len(names) else 0
            first, lowest, highest = i - 1, before[i - 1], before[i - 1]
            while stack and stack[-1][0] > now:
                depth, first, lo, hi = stack.pop()
                lowest, highest = min(lowest, lo), max(highest, hi)
                if lowest != highest:
                    yield depth, names[first:i]
            if i and stack and stack[-1][0] == now:
                stack[-1][2], stack[-1][3] = min(stack[-1][2], lowest), max(stack[-1][3], highest)
            elif i and now > 0:
                stack.append([now, first, lowest, highest])


_SPAN = "doc long, start long, stop long, cut boolean, words boolean"
_PIECE = "gram long, region long, doc long, start long, lead int, own int, words boolean, bytes binary"


def _spans(doc: np.ndarray, start: np.ndarray, stop: np.ndarray, cut: bool, words: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"doc": doc, "start": start, "stop": stop, "cut": np.full(len(doc), cut), "words": np.full(len(doc), words)})


def _in_windows(rows: list[tuple], words: int) -> Iterator[pa.RecordBatch]:
    """Spans of windows of so many words that stand more than once in the rows (gram, doc, start, own, words, codes of words)."""
    values = rolling(_mix(np.frombuffer(b"".join(r[5] for r in rows), dtype="<u4").astype(np.uint64) + np.uint64(1)), words)
    own = np.array([r[3] for r in rows])
    from_ = np.concatenate([[0], np.cumsum([len(r[5]) // CODE for r in rows])[:-1]])
    row = np.repeat(np.arange(len(rows)), own)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(own) - own, own)
    _, which, times = np.unique(values[from_[row] + inner], return_inverse=True, return_counts=True)
    again = np.flatnonzero(times[which] > 1)
    if not len(again):
        return
    row, inner = row[again], inner[again]
    # windows that have a word in common are one span
    opens = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (inner[1:] - inner[:-1] >= words)]))
    last = np.append(opens[1:], len(row)) - 1
    base = np.array([r[2] for r in rows])[row[opens]]
    yield _spans(np.array([r[1] for r in rows])[row[opens]], base + inner[opens], base + inner[last] + words, False, True)


def _in_arrays(regions: DataFrame, length: int, least_: int, words: int | None = None) -> DataFrame:
    """Spans (doc, start, stop, cut, words) of repeats between the regions (gram, doc, start, own, words, bytes) of a gram; cut: of `length` bytes or more."""

    def settle(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if of_words := [r for r in rows if r[4]]:
            yield from _in_windows(of_words, words)
        if rows := [r for r in rows if not r[4]]:
            yield from in_array(rows)

    def in_array(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        data = b"".join(r[5] for r in rows)
        ends = np.cumsum([len(r[5]) for r in rows])
        starts = np.concatenate([[0], ends[:-1]])
        names = np.array([r[0] for r in rows])
        group = np.cumsum(np.concatenate([[0], names[1:] != names[:-1]]))
        # the longest repeat from each place, of those that are cut and of all
        reach = np.zeros((2, len(data)), dtype=np.int64)
        for size, places in repeats(data, starts, ends, np.array([r[3] for r in rows]), group, 256 + np.arange(len(rows)), least_):
            for k in range(1 + (size >= length)):
                reach[k, places] = np.maximum(reach[k, places], size)
        # what overlaps or touches in a region is one span
        for k in range(2):
            at = np.flatnonzero(reach[k])
            if not len(at):
                continue
            row = np.searchsorted(ends, at, side="right")
            stop = np.maximum.accumulate(at + reach[k, at])  # no repeat goes beyond its region
            opens = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (at[1:] > stop[:-1])]))
            first, last, row = at[opens], stop[np.append(opens[1:], len(at)) - 1], row[opens]
            base = np.array([r[2] for r in rows])[row] - starts[row]
            yield _spans(np.array([r[1] for r in rows])[row], base + first, base + last, bool(k), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("gram", "doc", "start", "own", "words", "bytes")), strict=True):
                if rows and rows[-1][:3] == r[:3]:
                    continue
                if held > ARRAY and rows[-1][0] != r[0]:
                    yield from settle(rows)
                    rows, held = [], 0
                rows.append(r)
                held += len(r[5])
        if rows:
            yield from settle(rows)

    count = int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return regions.select("gram", "doc", "start", "own", "words", "bytes").repartition(count, "gram").sortWithinPartitions("gram", "doc", "start").mapInArrow(run, _SPAN)


def _finer(regions: DataFrame, block: int, length: int, least_: int, words: int | None = None) -> DataFrame:
    """Pieces (gram, region, doc, start, lead, own, words, bytes) of regions: `block` windows of least_ and of length bytes, or of so many words, each.

    Blocks are counted from the anchor. The new gram is a hash of the old one and of what all windows of the block hold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
        names = ["gram", "region", "doc", "start", "lead", "own", "words", "bytes"]
        for batch in batches:
            out: list[tuple] = []
            for gram, doc, start, lead, own, of_words, raw in zip(*(batch.column(c).to_pylist() for c in ("gram", "doc", "start", "lead", "own", "words", "bytes")), strict=True):
                unit = CODE if of_words else 1
                for size in {words} if of_words else {least_, length}:
                    at, stop, wide = 0, min(own, len(raw) // unit - size + 1), min(block, words if of_words else least_)
                    while at < stop:
                        base = (at - lead) // wide * wide + lead  # where the block begins, perhaps before the region
                        end = min(base + wide, stop)
                        core, piece = raw[(base + wide - 1) * unit : (base + size) * unit], raw[at * unit : (end - 1 + size) * unit]
                        salt = struct.pack("<qii", gram, size, base - lead)
                        name, same = (int.from_bytes(xxhash.xxh3_64_digest(x + salt), "little", signed=True) for x in (core, piece + struct.pack("<i", at - base)))
                        out.append((name, same, doc, start + at, lead - at, end - at, of_words, piece))
                        at = end
                if len(out) > 5_000:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)

    return regions.mapInArrow(run, _PIECE)


def _split(hot: DataFrame, length: int, least_: int, bucket: int, words: int | None = None) -> list[DataFrame]:
    """Spans of the regions (gram, doc, start, lead, own, words, bytes) of grams that have too many for one array."""
    found: list[DataFrame] = []
    size = F.octet_length("bytes")
    stop = F.col("start") + F.when(F.col("words"), F.shiftright(size, CODE.bit_length() - 1)).otherwise(size)
    for block in BLOCKS:
        pieces = saved(_finer(hot, block, length, least_, words))
        example = F.min(F.struct("doc", "start", "lead", "own", "words", "bytes")).alias("x")
        sums = saved(pieces.groupBy("gram", "region").agg(F.count("*").alias("n"), example))
        whole = pieces.join(sums.where("n > 1").select("gram", "region"), ["gram", "region"], "left_semi")
        found.append(whole.select("doc", "start", stop.alias("stop"), (~F.col("words") & (size >= length)).alias("cut"), "words"))
        grams = sums.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1")
        mixed = sums.join(grams, "gram").select("gram", "kinds", "x.*")
        found.append(_in_arrays(mixed.where(F.col("kinds") <= bucket), length, least_, words))
        hot = saved(mixed.where(F.col("kinds") > bucket).drop("kinds"))
        if hot.isEmpty():
            break
    return found


def spans(docs: DataFrame, length: int = LENGTH, least_: int = LENGTH, gram: int = GRAM, bucket: int = BUCKET, words: int | None = None) -> DataFrame:
    """(doc, start, stop, cut, words): byte spans of docs (doc, text, ..) that are made of repeated strings of least_ bytes, or (cut) of length bytes; they may overlap.

    If a number of words is given, spans of repeated passages of so many words, too, which are counted in words (where `words` is true).
    """
    found = saved(occurrences(docs, length, least_, gram, words))
    # most grams occur once: their anchors own no repeat
    twice = saved(found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"))
    # merge joins throughout: what stands on the right grows with the corpus, and both sides can be split where a gram is hot
    kept = saved(found.join(twice.hint("merge"), "gram", "left_semi"))
    regions = saved(kept.groupBy("gram", "region").agg(F.count("*").alias("n"), F.min(F.struct("doc", "place", "words")).alias("x")))
    whole = kept.join(regions.where("n > 1").select("gram", "region").hint("merge"), ["gram", "region"], "left_semi")
    whole = whole.select("doc", _start(F.col("place")).alias("start"), (_start(F.col("place")) + _size(F.col("place"))).alias("stop"), (~F.col("words") & (_size(F.col("place")) >= length)).alias("cut"), "words")
    grams = regions.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1")
    mixed = saved(regions.join(grams.hint("merge"), "gram").select("gram", "kinds", "x.*"))

    def wanted(which: Column) -> DataFrame:
        return mixed.where(which).groupBy("doc").agg(F.collect_list(F.struct("gram", "place", "words")).alias("want"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
        names = ["gram", "doc", "start", "lead", "own", "words", "bytes"]
        last = None
        for batch in batches:
            out: list[tuple] = []
            for key, text, want in zip(batch.column("doc").to_pylist(), batch.column("text"), batch.column("want"), strict=True):
                if key == last:  # equal rows share a key and follow one another: one of them is enough
                    continue
                last, raw, told = key, text.as_py().encode(), want.as_py()
                codes = (word_hashes(raw) >> np.uint64(32)).astype("<u4").tobytes() if any(w["words"] for w in told) else b""
                for w in told:
                    place = w["place"]
                    start = place >> 32
                    stop = start + (place & 0xFFF)
                    out.append((w["gram"], key, start, place >> 22 & 0x3FF, place >> 12 & 0x3FF, w["words"], codes[CODE * start : CODE * stop] if w["words"] else raw[start:stop]))
                if len(out) > 5_000:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)

    def fetched(want: DataFrame) -> DataFrame:
        return docs.join(want, "doc").mapInArrow(fetch, "gram long, doc long, start long, lead int, own int, words boolean, bytes binary")

    # docs are joined whole: a later join of the same rows by doc takes over what is shuffled here
    result = whole.unionByName(_in_arrays(fetched(wanted(F.col("kinds") <= bucket).hint("merge")), length, least_, words))
    if not mixed.where(F.col("kinds") > bucket).isEmpty():
        hot = saved(fetched(wanted(F.col("kinds") > bucket).hint("merge")).dropDuplicates(["gram", "doc", "start"]))
        for part in _split(hot, length, least_, bucket, words):
            result = result.unionByName(part)
    return result


def _covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans joined where they overlap or touch, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def remove(docs: DataFrame, length: int = LENGTH, least_: int | None = None, gram: int = GRAM, bucket: int = BUCKET, words: int | None = None) -> DataFrame:
    """Per document of (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept (binary), kept_sha256 and n_repeated.

    n_repeated counts the bytes covered by strings of least_ bytes (length, unless given) that also start elsewhere and, if a
    number of words is given, by passages of so many words (from the first one's start to the last one's stop) that also stand
    elsewhere; what no string of length bytes covers is kept.
    """
    least_ = least_ or length
    keyed = docs.select("doc_id", text_of().alias("text")).withColumn("doc", F.xxhash64("doc_id", "text"))
    marked = spans(keyed, length, least_, gram, bucket, words).groupBy("doc").agg(F.collect_set(F.struct("start", "stop", "cut", "words")).alias("spans"))
    kind = dict(keyed.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found in zip(batch.column("text"), batch.column("spans"), strict=True):
                raw = text.as_py().encode()
                told = found.as_py() or []
                gone = _covered([(x["start"], x["stop"]) for x in told if x["cut"]])
                seen = [(x["start"], x["stop"]) for x in told if not x["words"]]
                if len(seen) < len(told):
                    starts, stops = (x.tolist() for x in word_bounds(raw))
                    seen += [(starts[x["start"]], stops[x["stop"] - 1]) for x in told if x["words"]]
                edges = [0, *(x for span in gone for x in span), len(raw)]
                rest = b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                out.append((len(raw), len(raw) - len(rest), len(gone), rest, hashlib.sha256(rest).hexdigest(), sum(e - s for s, e in _covered(seen))))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64())
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "n_repeated"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)]], names=names)

    joined = keyed.join(marked.hint("merge"), "doc", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string, n_repeated long")
