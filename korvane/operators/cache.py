"""Similarity cache: lookup among the newest live entries, insert and purge."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .gate import is_meta
from .vector import DIGITS, _matrix

SCAN_LIMIT = 500
THRESHOLD = 0.92
TTL_SECONDS = 86_400


def live_entries(cache: DataFrame, now, limit: int | None = SCAN_LIMIT) -> DataFrame:
    """The newest entries that have not expired; ``None`` looks at all of them."""
    live = cache.filter(F.col("expires_at") > now).orderBy(F.desc("created_at"), F.desc("entry_id"))
    return live if limit is None else live.limit(limit)


def cache_lookup(queries: DataFrame, cache: DataFrame, now, *, threshold: float = THRESHOLD,
                 limit: int | None = SCAN_LIMIT, query_id="query_id", query_vec="query_vec",
                 vec="embedding") -> DataFrame:
    """(query_id, entry_id, score) for queries with an entry at or above the threshold.

    At most ``limit`` entries are held by the tasks; the queries, batch or stream, pass by
    without a shuffle. The newest entry wins ties.
    """
    rows = live_entries(cache, now, limit).select("entry_id", vec).collect()
    shared = cache.sparkSession.sparkContext.broadcast(
        ([r[0] for r in rows], [r[1] for r in rows]))
    schema = T.StructType([T.StructField(query_id, queries.schema[query_id].dataType),
                           T.StructField("entry_id", cache.schema["entry_id"].dataType),
                           T.StructField("score", T.DoubleType())])

    def scan(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        ids, vectors = shared.value
        by_size = {}
        for i, v in enumerate(vectors):
            if v:
                by_size.setdefault(len(v), []).append(i)
        mats = {n: _matrix([vectors[i] for i in pos]) for n, pos in by_size.items()}
        arrow = to_arrow_schema(schema)
        for batch in batches:
            out = {query_id: [], "entry_id": [], "score": []}
            for q, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not v or len(v) not in mats:
                    continue
                scores = np.round(mats[len(v)] @ _matrix([v])[0], DIGITS)
                best = int(np.argmax(scores))  # first maximum = newest
                if scores[best] >= threshold:
                    out[query_id].append(q)
                    out["entry_id"].append(ids[by_size[len(v)][best]])
                    out["score"].append(float(scores[best]))
            yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return queries.select(query_id, query_vec).mapInArrow(scan, schema)


def cache_put(df: DataFrame, text="text", ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """Rows to store, with their expiry; small talk is not cached."""
    return df.filter(~is_meta(text)).withColumn(
        "expires_at", F.col("created_at") + F.make_dt_interval(secs=F.lit(ttl_seconds)))


def cache_purge(cache: DataFrame, now) -> DataFrame:
    return cache.filter(F.col("expires_at") > now)
