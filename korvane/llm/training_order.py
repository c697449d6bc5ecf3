"""Token-ID output (3): training-order materialisation.

Texts become ids, documents are packed one behind the other (an end id between them) into
sequences of a fixed length, and a keyed Feistel permutation with cycle-walking gives every
sequence a global slot, which is a bijection of the N sequences. Shard s holds the slots from
s * R on, in order; each is a run of fixed-size records, so the record of a slot stands at a place
that is computed, and training reads forward from any slot.

Sequences are numbered without a sort: a task writes its sequences with its own number and their
place in it, the counts per task give offsets, and from then on these are columns of a written
table, which a recomputed task finds as they were. Between the tasks sequences travel compressed.
Shards are written with Spark's text sink, whose line end is the last byte of every record, so they
may lie on any file system that Spark knows; each shard is one file in ``shard=<number>``.

Edge cases: null and empty texts are documents without ids and leave only their end id. A text of
any length runs on over as many sequences as it needs. The last sequence of a task is filled up
with end ids and knows how many it really has. Repeated rows and null ids are documents like any
other. An empty table gives no shards. Other columns are never read.
"""

from __future__ import annotations

import base64
import math

import numpy as np
import pyarrow as pa
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from korvane.session import materialize

from .arrays import slices

PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
LENGTH = 8192             # ids of a sequence
SHARD = 1024              # records of a shard: 16 MB
ROUNDS = 4
STEP = 64                 # records handed on together when shards are read


class Tokenizer:
    """A rank file's vocabulary; its first free id ends documents."""

    def __init__(self, path: str, pattern: str = PATTERN):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern, self.end = pattern, max(self.ranks.values()) + 1
        if self.end > 0xFFFF:
            raise ValueError("ids must fit two bytes")

    def open(self) -> tiktoken.Encoding:
        return tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=self.ranks,
                                 special_tokens={})


def feistel_slot(index: Column, n: int, key: int, rounds: int = ROUNDS) -> Column:
    """The keyed permutation of [0, n) as a column expression.

    A value is a pair (left, right) of a * b >= n with a the root of n; each round adds a keyed
    hash of one half to the other, modulo its range, which permutes the a * b pairs. A value that
    falls outside [0, n) walks on until it is inside, as its cycle holds the value it came from. At
    most a * b - n < a + b values lie outside, so a walk is that long at most, and beyond a few
    steps only where nearly all values lie inside; should one not end, the job fails and says so.
    """
    a = math.isqrt(max(1, n) - 1) + 1
    b = -(-max(1, n) // a)
    steps = min(a * b - n + 1, 64)

    def once(x: Column) -> Column:
        left, right = F.floor(x / F.lit(b)).cast("long"), x % F.lit(b)
        for r in range(rounds):
            left = F.pmod(left + F.pmod(F.xxhash64(F.lit(key), F.lit(2 * r), right), F.lit(a)),
                          F.lit(a))
            right = F.pmod(right + F.pmod(F.xxhash64(F.lit(key), F.lit(2 * r + 1), left), F.lit(b)),
                           F.lit(b))
        return left * F.lit(b) + right

    index = index.cast("long")
    end = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), index, lambda x, i: F.when(
        (i == 1) | (x >= n), once(x)).otherwise(x))
    return F.when(end < n, end).otherwise(F.raise_error(F.lit("a walk did not end")).cast("long"))


def sequences(docs: DataFrame, id_col: str, text_col: str, tokenizer: Tokenizer,
              length: int) -> DataFrame:
    """(task, place, used, docs, data): packed sequences, ``data`` compressed little-endian ids."""
    # plain values, as workers need not have this package
    shared = docs.sparkSession.sparkContext.broadcast(vars(tokenizer))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        told = Tokenizer.__new__(Tokenizer)
        vars(told).update(shared.value)
        encoding, end = told.open(), told.end
        pack = zstandard.ZstdCompressor(level=9).compress
        task, place = TaskContext.get().partitionId(), 0
        ids, owners = [], []              # what is not yet a full sequence

        def emit(full):
            nonlocal place
            out = {"place": [], "used": [], "docs": [], "data": []}
            flat = np.concatenate(ids) if ids else np.zeros(0, np.uint16)
            ends = np.cumsum([len(x) for x in ids])
            at = 0
            while len(flat) - at >= length or (not full and at < len(flat)):
                piece = flat[at:at + length]
                first, last = np.searchsorted(ends, [at, at + len(piece) - 1], "right")
                out["place"].append(place), out["used"].append(len(piece))
                out["docs"].append(list(dict.fromkeys(owners[first:last + 1])))
                if len(piece) < length:
                    piece = np.append(piece, np.full(length - len(piece), end, np.uint16))
                out["data"].append(pack(piece.astype("<u2").tobytes()))
                place += 1
                at += length
            rest = int(np.searchsorted(ends, at, "right"))
            del owners[:rest]
            ids[:] = [flat[at:]] if at < len(flat) else []
            if len(owners) > 1:           # the open document keeps its own part
                ids[:] = np.split(flat[at:], ends[rest:-1] - at)
            if out["place"]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([task] * len(out["place"]), pa.int64()),
                     pa.array(out["place"], pa.int64()), pa.array(out["used"], pa.int32()),
                     pa.array(out["docs"], pa.list_(kind)), pa.array(out["data"], pa.binary())],
                    names=["task", "place", "used", "docs", "data"])

        kind = pa.int64()
        for batch in batches:
            for part in slices(batch, "_text"):
                kind = part.column(0).type
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    got = encoding.encode_ordinary(text) if text else []
                    ids.append(np.array([*got, end], np.uint16))
                    owners.append(doc)
                yield from emit(True)
        yield from emit(False)

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(
        run, f"task long, place long, used int, docs array<{id_type}>, data binary")


def numbered(packed: DataFrame) -> tuple[DataFrame, int]:
    """``index`` over all sequences: the task's offset plus the place in it; and their number."""
    counts = packed.groupBy("task").agg(F.count("task").alias("n"))
    before = W.orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    offsets = materialize(counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))),
                          "offsets")
    n = offsets.agg(F.sum("n")).first()[0] or 0
    # two numbers per task of the job that wrote the sequences, whatever their size
    return packed.join(F.broadcast(offsets.select("task", "offset")), "task") \
        .withColumn("index", F.col("offset") + F.col("place")).drop("offset"), n


def write_shards(rows: DataFrame, path: str, per_shard: int = SHARD) -> None:
    """One file of fixed-size records per shard, in slot order, from (slot, data)."""
    def unpack(batches):
        open_ = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.array([open_(x) for x in batch.column(2).to_pylist()], pa.binary())],
                names=["shard", "slot", "data"])

    shard = F.floor(F.col("slot") / per_shard).cast("long")
    (rows.select(shard.alias("shard"), "slot", "data").repartitionByRange("shard")
     .mapInArrow(unpack, "shard long, slot long, data binary")
     # sorted last, so that the writer finds its order and does not sort again
     .sortWithinPartitions("shard", "slot")
     # the bytes as they are; the sink adds its line end as the record's last byte
     .select("shard", F.col("data").cast("string").alias("value"))
     .write.partitionBy("shard").option("lineSep", "\n").text(path))


def read_slots(spark: SparkSession, path: str, start: int = 0, length: int = LENGTH,
               per_shard: int = SHARD) -> DataFrame:
    """(slot, data) from ``start`` on; whole shards before it are not opened."""
    stride = 2 * length + 1
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path) \
        .select(F.col("shard").cast("long").alias("shard"), "content") \
        .filter(F.col("shard") >= start // per_shard)

    def cut(batches):
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = memoryview(content.as_buffer())
                for lo in range(0, len(raw) // stride, STEP):
                    some = range(lo, min(lo + STEP, len(raw) // stride))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard * per_shard + i for i in some], pa.int64()),
                         pa.array([bytes(raw[i * stride:i * stride + 2 * length]) for i in some],
                                  pa.binary())], names=["slot", "data"])

    return files.mapInArrow(cut, "slot long, data binary").filter(F.col("slot") >= start)


def materialise(docs: DataFrame, tokenizer: Tokenizer, path: str, key: int = 2024,
                id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                per_shard: int = SHARD) -> DataFrame:
    """Write the shards; (index, slot, used, docs) of every sequence."""
    packed = materialize(sequences(docs, id_col, text_col, tokenizer, length), "sequences")
    rows, n = numbered(packed)
    rows = rows.withColumn("slot", feistel_slot(F.col("index"), n, key))
    if n:
        write_shards(rows.select("slot", "data"), path, per_shard)
    return rows.select("index", "slot", "used", "docs")
