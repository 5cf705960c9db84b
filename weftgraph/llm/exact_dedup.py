"""Exact dedup by Grace hashing.

Spark's exchange by a 64-bit hash of the text is the first partitioning. In a task, rows stream
into an open-addressing table that holds distinct contents only. Should these outgrow the limit,
table and remaining rows go to spill files by the next bits of the hash, and each file is treated
in the same way. Rows with equal hashes are compared by their complete content.

Before the exchange, each task drops the copies among its own rows with such a table, which is
emptied when it is full. So a content that makes up a third of all rows goes to its task a few
times for each task that read it.

Spill files are in the folder that all executors share, under a name of the task attempt's own, and
are removed when the task is done with them; nothing else reads them, so a lost executor costs no
more than its tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, pick, shared_dir

#: Bytes that a task's table may hold, rows and contents; hash bits that a level of spill files takes; bytes of an entry besides.
TABLE_BYTES, FANOUT_BITS, ENTRY_BYTES = 96_000_000, 4, 300


class Table:
    """Open addressing with linear probing; a slot has the number of an entry."""

    def __init__(self) -> None:
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []

    def find(self, h: int, content: bytes) -> tuple[int, bool]:
        """(entry, whether it is new)."""
        mask = len(self.slots) - 1
        i = (h ^ (h >> 31)) & mask
        while (e := self.slots[i]) >= 0:
            if self.hashes[e] == h and self.contents[e] == content:
                return e, False
            i = (i + 1) & mask
        self.slots[i] = e = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        if 3 * len(self.hashes) > 2 * len(self.slots):
            self.grow()
        return e, True

    def grow(self) -> None:
        mask = 2 * len(self.slots) - 1
        self.slots = [-1] * (mask + 1)
        for e, h in enumerate(self.hashes):
            i = (h ^ (h >> 31)) & mask
            while self.slots[i] >= 0:
                i = (i + 1) & mask
            self.slots[i] = e


class Spill:
    """The spill files of one level, written as Arrow streams."""

    def __init__(self, root: str, schema: pa.Schema) -> None:
        self.files, base = fs.FileSystem.from_uri(root)
        self.at, self.schema = f"{base}/{uuid.uuid4().hex}", schema
        self.files.create_dir(self.at)
        self.open: dict[int, tuple] = {}

    def write(self, batch: pa.RecordBatch, bucket: list[int]) -> None:
        rows: dict[int, list[int]] = {}
        for i, k in enumerate(bucket):
            rows.setdefault(k, []).append(i)
        for k, own in rows.items():
            if k not in self.open:
                sink = self.files.open_output_stream(f"{self.at}/{k}")
                self.open[k] = (sink, pa.ipc.new_stream(sink, self.schema))
            self.open[k][1].write_batch(batch.take(pa.array(own)))

    def read(self) -> Iterator[Iterator[pa.RecordBatch]]:
        for sink, writer in self.open.values():
            writer.close()
            sink.close()
        for k in self.open:
            with self.files.open_input_stream(f"{self.at}/{k}") as source, pa.ipc.open_stream(source) as reader:
                yield iter(reader)
            self.files.delete_file(f"{self.at}/{k}")

    def remove(self) -> None:
        self.files.delete_dir(self.at)


class Held:
    """A table of contents with the row to keep of each."""

    def __init__(self) -> None:
        self.table, self.held, self.size = Table(), [], 0
        self.ranks: list = []
        self.counts: list[int] = []
        self.place: list[tuple[int, int]] = []

    def add(self, batch: pa.RecordBatch) -> None:
        fresh: dict[int, int] = {}
        hashes, rank, many = (batch.column(k).to_pylist() for k in ("h", "r", "n"))
        texts = batch.column("t")
        for i, h in enumerate(hashes):
            content = texts[i].as_py()
            e, new = self.table.find(h, content)
            own = tuple(rank[i].values())
            if new:
                self.ranks.append(own)
                self.counts.append(many[i])
                self.place.append((len(self.held), -1))
                self.size += len(content) + ENTRY_BYTES
                fresh[e] = i
            else:
                self.counts[e] += many[i]
                if own < self.ranks[e]:
                    self.ranks[e] = own
                    fresh[e] = i
        if fresh:
            for k, e in enumerate(fresh):
                self.place[e] = (len(self.held), k)
            self.held.append(batch.take(pa.array(list(fresh.values()))))
            self.size += self.held[-1].nbytes

    def rows(self) -> Iterator[pa.RecordBatch]:
        return rows(self.held, self.place, self.counts)


def local(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """The batches without copies of what the table still holds, which begins anew beyond the limit."""
    own = Held()
    for batch in batches:
        own.add(batch)
        if own.size > limit:
            yield from own.rows()
            own = Held()
    yield from own.rows()


def grace(batches: Iterator[pa.RecordBatch], root: str, limit: int, level: int = 0) -> Iterator[pa.RecordBatch]:
    """The rows to keep. Columns named h (hash), t (content), r (rank, least is kept) and n (rows that it stands for) are used."""
    own, schema = Held(), None
    for batch in batches:
        if not batch.num_rows:
            continue
        schema = batch.schema
        own.add(batch)
        if own.size > limit and len(own.counts) > 1 and (level + 1) * FANOUT_BITS <= 64:
            break
    else:
        yield from own.rows()
        return
    bucket = lambda hs: [(h >> (64 - (level + 1) * FANOUT_BITS)) & ((1 << FANOUT_BITS) - 1) for h in hs]
    spill = Spill(root, schema)
    try:
        for part in own.rows():
            spill.write(part, bucket(part.column("h").to_pylist()))
        del own
        for batch in batches:
            if batch.num_rows:
                spill.write(batch, bucket(batch.column("h").to_pylist()))
        for part in spill.read():
            yield from grace(part, root, limit, level + 1)
    finally:
        spill.remove()


def rows(held: list[pa.RecordBatch], place: list[tuple[int, int]], counts: list[int]) -> Iterator[pa.RecordBatch]:
    by: dict[int, list[tuple[int, int]]] = {}
    for e, (b, k) in enumerate(place):
        by.setdefault(b, []).append((k, e))
    for b, own in by.items():
        batch = held[b].take(pa.array([k for k, _ in own]))
        at = batch.schema.get_field_index("n")
        yield batch.set_column(at, batch.schema.field(at), pa.array([counts[e] for _, e in own], pa.int64()))


def dedup(docs: DataFrame, limit: int = TABLE_BYTES) -> DataFrame:
    """One row of each content, with positional columns and n (rows of this content).

    The row with the least doc_id stays, a null counting as the greatest; rows that tie in doc_id
    too are told apart by a hash of their other columns, and if that ties, any of them stays.
    Defined cases: a null text has no content to compare, so each such row stays (n is 1); empty
    texts equal each other; repeated rows leave one; an empty table gives an empty one; extra
    columns are carried along; doc_id keeps its type.
    """
    spark = docs.sparkSession
    out, where, _ = flat(docs)
    text, doc = F.col(where["text"]), F.col(where["doc_id"])
    others = [f.name for f in out.schema if f.name != where["text"] and not any(x in f.dataType.simpleString() for x in ("map", "variant"))]
    rank = F.struct(doc.isNull().cast("int").alias("a"), doc.alias("b"), F.xxhash64(*others).alias("c"))
    columns = out.columns
    keyed = out.select("*", F.xxhash64(text).alias("h"), text.cast("binary").alias("t"), rank.alias("r"), F.lit(1).cast("long").alias("n"))
    keyed = keyed.drop(where["text"])
    root = shared_dir(spark)
    keyed = keyed.where(F.col("t").isNotNull())
    spread = keyed.mapInArrow(lambda batches: local(batches, limit), keyed.schema).repartition("h")
    kept = spread.mapInArrow(lambda batches: grace(batches, root, limit), spread.schema)
    kept = kept.withColumn(where["text"], F.col("t").cast("string")).select(*columns, "n")
    return kept.unionAll(out.where(text.isNull()).withColumn("n", F.lit(1).cast("long")))


def deduplicated(docs: DataFrame, limit: int = TABLE_BYTES) -> DataFrame:
    """The documents that stay, with the columns of docs."""
    return dedup(docs, limit).drop("n").toDF(*docs.columns)


def survivors(docs: DataFrame, limit: int = TABLE_BYTES) -> DataFrame:
    """(doc_id, n_copies): the documents that stay, and how many rows had their content."""
    own = pick(docs, "doc_id", "text")
    _, where, _ = flat(own)
    return dedup(own, limit).select(F.col(where["doc_id"]).alias("doc_id"), F.col("n").alias("n_copies"))


ORACLE = """
SELECT min(doc_id) AS doc_id, count(*) AS n_copies FROM documents WHERE text IS NOT NULL GROUP BY text
UNION ALL SELECT doc_id, 1 FROM documents WHERE text IS NULL
"""
