"""Streaming forms: the batch operators on ``readStream`` inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..dist import first_per
from ..operators.cache import cache_lookup, cache_put
from ..operators.extract import extract_articles
from ..operators.gate import route_turns
from ..operators.memory import apply_decisions
from ..schemas import HISTORY, MEMORY_SCHEMA, REPORT
from ..session import discard, materialize
from ..sources.readers import shape_pages
from .store import PieceTable


def gate_stream(turns: DataFrame, answers: dict[str, str], **kw) -> DataFrame:
    """Decision per incoming turn; stateless, so it scales with the source's partitions."""
    return route_turns(turns, answers, **kw)


def shared_log(sdf: DataFrame, out: str, checkpoint: str,
               rows: Callable[[DataFrame, int], DataFrame], schema: T.StructType) -> DataFrame:
    """Drain what is there; ``rows`` of each micro-batch become its folder ``batch=N`` of a log, which
    a replayed batch overwrites. Returns the log as a table."""
    def apply(batch: DataFrame, n: int) -> None:
        rows(batch, n).select(*schema.names).write.mode("overwrite").parquet(f"{out}/batch={n}")

    _drain(sdf, apply, checkpoint)
    return _log(sdf.sparkSession, out, schema)


def _log(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])) \
        .parquet(out).select(*schema.names)


def _drain(sdf: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    (sdf.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def cache_table(spark: SparkSession, root: str, entries: T.StructType, key: str = "entry_id",
                buckets: int = 16) -> PieceTable:
    """Where streamed cache entries are kept, with ``expires_at`` among their columns."""
    return PieceTable(spark, root, entries, key, buckets, until="expires_at")


def cache_lookup_stream(queries: DataFrame, cache: PieceTable | DataFrame, now, out: str,
                        checkpoint: str, **kw) -> DataFrame:
    """Answers of a stream of queries, each from the entries stored when its micro-batch runs.

    ``now`` is a time or, per micro-batch, a function of its number; left out, it is the time the
    batch runs. An entry put between two batches is found by the second, one that has expired by
    its clock is not.
    """
    def answer(batch: DataFrame, n: int) -> DataFrame:
        entries = cache.read() if isinstance(cache, PieceTable) else cache
        return cache_lookup(batch, entries, _clock(now, n), **kw)

    id_col = kw.get("query_id", "query_id")
    schema = T.StructType([queries.schema[id_col], cache.schema["entry_id"],
                           T.StructField("score", T.DoubleType())])
    return shared_log(queries, out, checkpoint, answer, schema)


def _clock(now, n: int):
    if now is None:
        return F.current_timestamp()
    return now(n) if callable(now) else now


def cache_put_stream(turns: DataFrame, cache: PieceTable, checkpoint: str, now=None,
                     most_pieces: int = 32, **kw) -> Callable[[], DataFrame]:
    """Store a stream of entries; small talk is left out. Returns a reader of what is stored.

    However late an entry comes it is stored, once: entries that the table holds already do not come
    in again, whatever batch or replay brings them, and of the same entry twice in a batch the
    earliest stays. With ``now`` (as in ``cache_lookup_stream``), pieces whose entries have all expired
    go. A batch adds pieces; a bucket of ``most_pieces`` is written anew as one.
    """
    key = cache.key

    def apply(batch: DataFrame, n: int) -> None:
        new = first_per(cache_put(batch, **kw), key, ["created_at", "expires_at"])
        new = new.join(cache.read(n).select(key), key, "left_anti").select(*cache.schema.names)
        held: dict[int, int] = {}
        for p in cache.pieces(n):
            held[p.bucket] = held.get(p.bucket, 0) + 1
        full = sorted(b for b, pieces in held.items() if pieces >= most_pieces)
        clock = turns.sparkSession.range(1).select(
            F.lit(_clock(now, n)).cast("timestamp")).first()[0] if now is not None else None
        if full:
            old = cache.read(n, full)
            new = new.unionByName(old if clock is None else old.filter(F.col("expires_at") > F.lit(clock)))
        cache.write(new, n, full, None if clock is None else lambda p: p.until is None or p.until > clock)

    _drain(turns, apply, checkpoint)
    return cache.read


def page_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """New page files as they arrive; the query's checkpoint remembers the files done."""
    reader = spark.readStream.format("text").option("wholetext", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return shape_pages(reader.load(path).select("value", "_metadata"))


def ingest_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    return extract_articles(page_stream(spark, path, files_per_batch))


def ingest_changes(pages: DataFrame, root: str, checkpoint: str, page_id: str = "page_id", html: str = "html",
                   order: str | None = None, buckets: int = 256) -> Callable[[], DataFrame]:
    """Keep a table of articles up to date from a stream of pages. Returns its reader.

    A digest is kept per page: a page sent again as it was changes nothing and is not parsed, a
    changed one replaces its articles, also by none. Of a page that a batch holds several times the
    one last in ``order`` counts (without it, the one with the largest text). Only the buckets of
    changed pages are written, and a replayed batch overwrites its own output.
    """
    spark = pages.sparkSession
    articles = PieceTable(spark, f"{root}/articles", extract_articles(pages, page_id, html).schema, "page_id", buckets)
    seen = PieceTable(spark, f"{root}/seen", T.StructType([
        T.StructField("page_id", pages.schema[page_id].dataType), T.StructField("digest", T.StringType())]),
        "page_id", buckets)

    def apply(batch: DataFrame, n: int) -> None:
        last = first_per(batch.filter(F.col(page_id).isNotNull()), page_id, [*([F.desc(order)] if order else []), F.desc(html)]) \
            .select(F.col(page_id).alias("page_id"), F.coalesce(html, F.lit("")).alias("html"))
        known = seen.read(n)
        new = materialize(last.withColumn("digest", F.sha2("html", 256))
                          .join(known, ["page_id", "digest"], "left_anti"), "changed-pages")
        touched = [r[0] for r in new.select(seen.bucket()).distinct().collect()]     # at most ``buckets``
        if touched:
            ids = new.select("page_id")
            for table, rows in ((articles, extract_articles(new)), (seen, new.select("page_id", "digest"))):
                table.write(table.read(n, touched).join(ids, "page_id", "left_anti").unionByName(rows), n, touched)
        discard(new)

    _drain(pages, apply, checkpoint)
    return articles.read


def run_to_table(sdf: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Drain what is there into parquet with exactly-once file output, then read it."""
    query = (sdf.writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", checkpoint).outputMode("append")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return sdf.sparkSession.read.schema(sdf.schema).parquet(out)


#: What the memory stream keeps of a memory: its columns, the id and version it began with.
MEMORY_STATE = T.StructType([
    *MEMORY_SCHEMA.fields, T.StructField("source_chat_id", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("root", T.LongType()), T.StructField("v0", T.IntegerType())])


class MemoryTables:
    """Readers of a memory stream's tables; calling it gives the memories."""

    def __init__(self, state: PieceTable):
        self.state = state

    def __call__(self) -> DataFrame:
        return self.state.read().drop("root", "v0")

    def history(self) -> DataFrame:
        """Every decision that took effect, as in ``apply_decisions``, over all batches."""
        return _log(self.state.spark, f"{self.state.root}/history", HISTORY)

    def report(self) -> DataFrame:
        """What became of every decision."""
        return _log(self.state.spark, f"{self.state.root}/report", REPORT)


def memory_stream(decisions: DataFrame, state_root: str, first: DataFrame | None,
                  checkpoint: str, buckets: int = 256, **kw) -> MemoryTables:
    """Keep the memory table, its history and its report up to date from a stream of decisions.

    Users are hashed to buckets and each micro-batch writes only the buckets it touches; the
    manifest names the live version of each and superseded ones are deleted. History and report of
    a batch are its own folders. A replayed batch reads what lies before it and overwrites its
    output, so a restart changes nothing. ``first`` starts a new table and is left out on a restart.
    """
    state = PieceTable(decisions.sparkSession, state_root, MEMORY_STATE, "user_id", buckets)

    def begun(mem: DataFrame) -> DataFrame:
        more = {f.name: F.lit(None).cast(f.dataType) for f in MEMORY_STATE if f.name not in mem.columns}
        return mem.withColumns(more | {"root": F.col("mem_id"), "v0": F.col("version")})

    def apply(batch: DataFrame, n: int) -> None:
        rows = batch.persist()
        touched = [r[0] for r in rows.select(state.bucket()).distinct().collect()]  # at most ``buckets``
        before = state.read(n, touched)
        out, history, report = apply_decisions(before, rows, begin={
            "root": F.col("mem_id"), "v0": F.col("version")}, **kw)
        # a chain goes on where earlier batches left it
        at = before.select(F.col("user_id").alias("_u"), F.col("mem_id").alias("_m"),
                           F.col("root").alias("_root"), (F.col("version") - F.col("v0")).alias("_steps"))
        history = history.join(at, (F.col("user_id") == F.col("_u")) & (F.col("root") == F.col("_m")), "left") \
            .withColumns({"root": F.coalesce("_root", "root"),
                          "depth": (F.col("depth") + F.coalesce("_steps", F.lit(0))).cast("int")})
        history.select(*HISTORY.names).write.mode("overwrite").parquet(f"{state_root}/history/batch={n}")
        report.select(*REPORT.names).write.mode("overwrite").parquet(f"{state_root}/report/batch={n}")
        state.write(out, n, touched)
        rows.unpersist()

    if first is not None:
        state.write(begun(first), -1)
    _drain(decisions, apply, checkpoint)
    return MemoryTables(state)
