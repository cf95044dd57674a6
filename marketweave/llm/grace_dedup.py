"""Exact deduplication by Grace hashing: buckets on disk, split again until an open-addressing table holds each.

Texts are equal when all their bytes are, after lower-casing A-Z. Three steps:

1. Every task enters its texts into a table of bounded size and writes two kinds of rows to one
   spill file: a member for each document, and a partial for each different text with the number
   of its documents and the best of them. So a text of a third of all rows is one partial a task.
2. Partials are dealt into buckets by the first bits of a hash of the text. A bucket whose different
   texts exceed BUCKET bytes is written to spill files of its own and dealt by the next bits, again
   and again. A bucket that fits streams through one open-addressing table, which compares complete
   contents: equal hashes alone decide nothing. It answers a row per partial.
3. Members are joined with the answers by the number of their partial: no key of that join has
   more rows than one task has read, however large a group is.

Defined cases: a null text is an empty one and equals it; the row of the largest doc_id of a group
stays, null ids last, and exactly one row of those that share that id; a group of null ids only has
keep_id null and still keeps one row; a bucket of one hash is never split, whatever its size; an empty
table gives an empty result; further columns are ignored, or returned as they are by `deduplicate`.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marketweave.llm.common import cut, saved, small

#: Bytes of different texts that one table holds, in a bucket and in a task of step 1.
BUCKET, TASK = 32 << 20, 16 << 20
#: Bits of the hash by which an oversize bucket is dealt once more; bits of the hash.
BITS, HASH = 4, 64
#: Rows whose lower-cased texts are held beside the table.
SLICE = 1_000
#: What a text takes in a table beside its bytes, about.
ENTRY = 100

_ANSWER = "partial long, kept_nth long, keep_id long, group_size long, text_sha256 string"


class Contents:
    """Different contents in order of entry, found by open addressing with linear probing."""

    def __init__(self) -> None:
        self.slots, self.mask = [-1] * 1024, 1023
        self.hashes: list[int] = []
        self.ends = [0]
        self.arena = bytearray()

    def __len__(self) -> int:
        return len(self.hashes)

    def content(self, at: int) -> memoryview:
        return memoryview(self.arena)[self.ends[at] : self.ends[at + 1]]

    def enter(self, hash_: int, content: memoryview) -> int:
        """The number of the content, which is entered if it is new."""
        slots, mask, size = self.slots, self.mask, len(content)
        slot = hash_ & mask
        while (at := slots[slot]) >= 0:
            if self.hashes[at] == hash_ and self.ends[at + 1] - self.ends[at] == size and self.content(at) == content:
                return at
            slot = (slot + 1) & mask
        at = slots[slot] = len(self.hashes)
        self.hashes.append(hash_)
        self.arena += content
        self.ends.append(len(self.arena))
        if 2 * at > mask:
            self._grow()
        return at

    def _grow(self) -> None:
        self.mask = 4 * len(self.slots) - 1
        slots = self.slots = [-1] * (self.mask + 1)
        for at, hash_ in enumerate(self.hashes):
            slot = hash_ & self.mask
            while slots[slot] >= 0:
                slot = (slot + 1) & self.mask
            slots[slot] = at


class Group:
    """Documents of one content: their number and the best of them."""

    __slots__ = ("best", "n", "place")

    def __init__(self) -> None:
        self.n, self.best, self.place = 0, None, None

    def add(self, n: int, doc_id: int | None, place: tuple[int, int]) -> None:
        self.n += n
        if self.place is None or (doc_id is not None and (self.best is None or doc_id > self.best)) or (doc_id == self.best and place < self.place):
            self.best, self.place = doc_id, place


def _views(column: pa.Array) -> list[memoryview]:
    """The bytes of each value of a string or binary column, none of them copied."""
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    ends = memoryview(ends).cast("q" if large else "i")[column.offset : column.offset + len(column) + 1]
    whole = memoryview(data).cast("B") if data is not None else memoryview(b"")
    return [whole[ends[i] : ends[i + 1]] for i in range(len(column))]


def _dealt(docs: DataFrame, carry: StructType | None, hash_bits: int, task: int) -> DataFrame:
    """Members and partials of docs (doc_id, text, row): the spill rows of step 1."""
    schema = f"partial long, nth long, doc_id long, hash long, content binary, n long{f', row {carry.simpleString()}' if carry else ''}"
    cleared = HASH - hash_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, nth = TaskContext.get().partitionId() << 33, 0
        table, groups = Contents(), []

        def spilled() -> Iterator[pa.RecordBatch]:
            at = 0
            while at < len(table):  # batches of bounded size
                end = at + 1
                while end < len(table) and table.ends[end + 1] - table.ends[at] < 4 << 20:
                    end += 1
                part, columns = groups[at:end], {}
                columns["partial"] = pa.array(range(base + at, base + end), pa.int64())
                columns["nth"] = pa.array([g.place[1] for g in part], pa.int64())
                columns["doc_id"] = pa.array([g.best for g in part], pa.int64())
                columns["hash"] = pa.array([h - (1 << 64) if h >> 63 else h for h in table.hashes[at:end]], pa.int64())
                columns["content"] = pa.array([bytes(table.content(i)) for i in range(at, end)], pa.binary())
                columns["n"] = pa.array([g.n for g in part], pa.int64())
                if row_type is not None:
                    columns["row"] = pa.nulls(end - at, row_type)
                yield pa.RecordBatch.from_pydict(columns)
                at = end

        row_type = None
        for batch in (whole.slice(low, SLICE) for whole in batches for low in range(0, whole.num_rows, SLICE)):
            texts = pc.fill_null(pc.ascii_lower(batch.column("text")), "")
            ids, places = batch.column("doc_id").to_pylist(), []
            for doc_id, content in zip(ids, _views(texts), strict=True):
                at = table.enter(xxhash.xxh3_64_intdigest(content) >> cleared << cleared, content)
                if at == len(groups):
                    groups.append(Group())
                groups[at].add(1, doc_id, (0, nth + len(places)))
                places.append(base + at)
            size = len(places)
            none = pa.nulls(size, pa.int64())
            members = {"partial": pa.array(places, pa.int64()), "nth": pa.array(range(nth, nth + size), pa.int64()), "doc_id": batch.column("doc_id"), "hash": none, "content": pa.nulls(size, pa.binary()), "n": none}
            if carry:
                row_type = batch.column("row").type
                members["row"] = batch.column("row")
            yield pa.RecordBatch.from_pydict(members)
            nth += size
            if len(table.arena) + ENTRY * len(table) > task:
                yield from spilled()
                base += len(table)
                table, groups = Contents(), []
        yield from spilled()

    columns = [F.col("doc_id").cast("long").alias("doc_id"), "text", *(["row"] if carry else [])]
    return docs.select(*columns).mapInArrow(run, schema)


def _settled(partials: DataFrame) -> DataFrame:
    """Answers of buckets that fit: each streams through one table."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, groups, of, names, nths = Contents(), [], [], [], []
        for batch in batches:
            rows = [batch.column(c).to_pylist() for c in ("hash", "partial", "nth", "doc_id", "n")]
            for content, hash_, partial, nth, doc_id, n in zip(_views(batch.column("content")), *rows, strict=True):
                at = table.enter(hash_ & (1 << 64) - 1, content)
                if at == len(groups):
                    groups.append(Group())
                groups[at].add(n, doc_id, (partial, nth))
                of.append(at)
                names.append(partial)
                nths.append(nth)
        digests = [hashlib.sha256(table.content(at)).hexdigest() for at in range(len(table))]
        for low in range(0, len(of), 10_000):
            part = of[low : low + 10_000]
            here = list(zip(names[low : low + 10_000], nths[low : low + 10_000], strict=True))
            yield pa.RecordBatch.from_pydict({
                "partial": pa.array([p for p, _ in here], pa.int64()),
                "kept_nth": pa.array([own[1] if groups[at].place == own else -1 for at, own in zip(part, here, strict=True)], pa.int64()),
                "keep_id": pa.array([groups[at].best for at in part], pa.int64()),
                "group_size": pa.array([groups[at].n for at in part], pa.int64()),
                "text_sha256": pa.array([digests[at] for at in part], pa.string()),
            })

    return partials.select("bucket", "partial", "nth", "doc_id", "hash", "content", "n").groupBy("bucket").applyInArrow(settle, _ANSWER)


def _answers(partials: DataFrame, bucket: int, hash_bits: int) -> DataFrame:
    """A row per partial: its group. Buckets that do not fit are written again and dealt by further bits."""
    size = F.octet_length("content").cast("long")
    entries = partials.select("hash", size.alias("size")).groupBy("hash", "size").agg(F.count("*").alias("copies"))
    entries = cut(entries.select("hash", (F.col("size") + ENTRY * F.col("copies")).alias("bytes")))
    total = entries.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first().n
    bits, found, todo = max(1, math.ceil(math.log2(max(1, 2 * total / bucket)))), None, partials
    while True:
        bits = min(bits, hash_bits)
        prefix = F.shiftrightunsigned("hash", HASH - bits)
        todo = todo.withColumn("bucket", prefix)
        sizes = entries.withColumn("bucket", prefix).groupBy("bucket").agg(F.sum("bytes").alias("bytes"), (F.min("hash") < F.max("hash")).alias("splits"))
        over = cut(sizes.where((F.col("bytes") > bucket) & F.col("splits")).select("bucket"))
        if bits == hash_bits or over.isEmpty():
            rest = _settled(todo)
            return rest if found is None else found.unionByName(rest)
        fits = _settled(todo.join(small(over), "bucket", "left_anti"))
        found = fits if found is None else found.unionByName(fits)
        todo = saved(todo.join(small(over), "bucket", "left_semi").drop("bucket"))
        entries = cut(entries.withColumn("bucket", prefix).join(small(over), "bucket", "left_semi").drop("bucket"))
        bits += BITS


def _groups(docs: DataFrame, carry: StructType | None, bucket: int, task: int, hash_bits: int) -> DataFrame:
    spilled = saved(_dealt(docs, carry, hash_bits, task))
    partials = spilled.where("content IS NOT NULL").select("partial", "nth", "doc_id", "hash", "content", "n")
    members = spilled.where("content IS NULL").select("partial", "nth", "doc_id", *(["row"] if carry else []))
    joined = members.join(_answers(partials, bucket, hash_bits), "partial")
    return joined.withColumn("kept", F.col("nth") == F.col("kept_nth")).drop("partial", "nth", "kept_nth")


def groups(docs: DataFrame, bucket: int = BUCKET, task: int = TASK, hash_bits: int = HASH) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept and text_sha256 of its normalised text.

    `hash_bits` below 64 leaves fewer bits of the hash, for tests of contents that collide.
    """
    found = _groups(docs.select("doc_id", "text"), None, bucket, task, hash_bits)
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def deduplicate(docs: DataFrame, bucket: int = BUCKET, task: int = TASK) -> DataFrame:
    """docs with one row of each group of equal texts, all columns as they are."""
    rows = docs.select("doc_id", "text", F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return _groups(rows, rows.schema["row"].dataType, bucket, task, HASH).where("kept").select("row.*")
