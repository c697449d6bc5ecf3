"""Tables that micro-batches change piece by piece; a manifest per batch names the live pieces.

A piece is ``data/version=N/bucket=B``: what batch N wrote for bucket B. A batch writes its pieces
first and its manifest last, so a reader sees all of a batch or nothing. A batch that runs again
starts from the manifest before its own and overwrites both. Pieces that neither the newest
manifest nor the one before it names are deleted. A table belongs to one stream checkpoint, whose
batch numbers name its versions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

MANIFEST = T.StructType([T.StructField("version", T.LongType()), T.StructField("bucket", T.IntegerType()),
                         T.StructField("rows", T.LongType()), T.StructField("until", T.TimestampType())])


class PieceTable:
    """``until`` names a timestamp column after which a row counts no longer, if there is one."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: str,
                 buckets: int = 256, until: str | None = None):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.key, self.buckets, self.until = key, buckets, until

    # -- files, by Spark's own file system layer --

    def _list(self, folder: str) -> list[str]:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    # -- manifests --

    def batches(self) -> list[int]:
        """Batches whose manifest is complete."""
        folder = f"{self.root}/manifest"
        found = [int(n[6:]) for n in self._list(folder) if n.startswith("batch=")]
        return sorted(n for n in found if "_SUCCESS" in self._list(f"{folder}/batch={n}"))

    def pieces(self, before: int | None = None) -> list:
        """The live pieces, or those before a batch; a few rows per bucket."""
        known = [n for n in self.batches() if before is None or n < before]
        if not known:
            return []
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/batch={known[-1]}").collect()

    def _path(self, piece) -> str:
        return f"{self.root}/data/version={piece.version}/bucket={piece.bucket}"

    # -- rows --

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def read(self, before: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The live rows; only live pieces are listed."""
        live = [p for p in self.pieces(before) if only is None or p.bucket in only]
        if not live:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[self._path(p) for p in live])

    def write(self, rows: DataFrame, batch: int, replaced: list[int] = (), keep=None) -> None:
        """Add ``rows`` as the pieces of ``batch``. Older pieces of the ``replaced`` buckets, and
        those that ``keep`` (a test of a piece) refuses, are live no longer."""
        older = [p for p in self.pieces(batch) if p.bucket not in replaced and (keep is None or keep(p))]
        path = f"{self.root}/data/version={batch}"
        # a bucket with a very busy key is split over several tasks and files
        (rows.select(*self.schema.names).withColumn("bucket", self.bucket()).hint("rebalance", "bucket")
         .write.mode("overwrite").partitionBy("bucket").parquet(path))
        until = F.max(self.until) if self.until else F.lit(None).cast("timestamp")
        written = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField(
            "bucket", T.IntegerType())])).parquet(path)
        new = written.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), until.alias("until")).select(
            F.lit(batch).cast("long").alias("version"), "bucket", "rows", "until")
        manifest = new.union(self.spark.createDataFrame(older, MANIFEST)) if older else new
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/batch={batch}")
        self._vacuum(batch)

    def _vacuum(self, batch: int) -> None:
        """Delete what only manifests before the last two name."""
        known = [n for n in self.batches() if n <= batch]
        live = {(p.version, p.bucket) for n in known[-2:] for p in self.pieces(n + 1)}
        for n in known[:-2]:
            for p in self.pieces(n + 1):
                if (p.version, p.bucket) not in live:
                    self._delete(self._path(p))
            self._delete(f"{self.root}/manifest/batch={n}")
        used = {v for v, _ in live} | {batch}
        for name in self._list(f"{self.root}/data"):
            if name.startswith("version=") and int(name[8:]) not in used and int(name[8:]) <= batch:
                self._delete(f"{self.root}/data/{name}")
