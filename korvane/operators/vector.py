"""Nearest neighbours by cosine, for many queries at once.

Tiles of both sides meet in a task, which ranks there and sends only k rows per query to the
shuffle, never the pairs. Scores are kept to 12 decimals so that equal vectors tie in
whichever block they were computed; ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..dist import first_per, top_per
from ..session import materialize

QUERY_ROWS, VECTOR_ROWS = 4_096, 16_384     # of a tile that a task holds
STEP_QUERIES, STEP_VECTORS = 512, 4_096     # of a score matrix: 16 MB
SHARD_CELLS = 64                            # of an inverted file that go together
DIGITS = 12


def _matrix(column) -> np.ndarray:
    """Unit rows of a list column; zero rows stay zero, so they score 0."""
    m = np.asarray([np.asarray(v, dtype=np.float64) for v in column])
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def key_array(values) -> np.ndarray:
    arr = np.asarray(list(values))
    return arr.astype(str) if arr.dtype == object else arr


def best_positions(scores: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of all scores that may be among the k best of their row, given the k-th so far."""
    if scores.shape[1] > k:
        floor = np.maximum(floor, np.partition(scores, -k, axis=1)[:, -k]) if np.isneginf(floor).any() else floor
    return np.nonzero(scores >= (floor - 10.0 ** -DIGITS)[:, None])


def _block(q_ids, q_mat, v_ids, v_mat, k, parts=None):
    """(query ids, ids, scores) of the k best per query, ties by id.

    ``parts`` are pairs of query rows and vector rows to compare (left out: all with all). The k best of
    all queries are kept as one matrix and only scores that reach a query's k-th best are looked at
    again; a score matrix never exceeds one step.
    """
    order = np.argsort(v_ids, kind="stable")            # of equal scores the first row is the smaller id
    v_ids, v_mat = v_ids[order], v_mat[order]
    if parts is None:
        parts = [(np.arange(len(q_mat)), np.arange(len(v_mat)))]
    else:
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        parts = ((rows, np.sort(place[cols])) for rows, cols in parts)
    odd = np.isnan(q_mat).any() or np.isnan(v_mat).any()
    best = np.full((len(q_mat), k), -np.inf)
    at = np.full((len(q_mat), k), -1)
    for rows, cols in parts:
        for lo in range(0, len(rows), STEP_QUERIES):
            some = rows[lo:lo + STEP_QUERIES]
            for first in range(0, len(cols), STEP_VECTORS):
                vs = cols[first:first + STEP_VECTORS]
                scores = q_mat[some] @ v_mat[vs].T
                if odd:
                    scores[np.isnan(scores)] = -np.inf
                r, c = best_positions(scores, best[some, -1], k)
                new = np.unique(r)
                score = np.concatenate([np.round(scores[r, c], DIGITS), best[some[new]].ravel()])
                found = np.concatenate([vs[c], at[some[new]].ravel()])
                row = np.concatenate([r, np.repeat(new, k)])
                rank = np.lexsort((found, -score, row))
                row, score, found = row[rank], score[rank], found[rank]
                pos = np.arange(len(row)) - np.searchsorted(row, row)
                top = pos < k
                best[some[row[top]], pos[top]] = score[top]
                at[some[row[top]], pos[top]] = found[top]
    r, c = np.nonzero((at >= 0) & (best > -np.inf))
    return q_ids[r], v_ids[at[r, c]], best[r, c]


def _shared_cells(asked, held: np.ndarray):
    """(query rows, vector rows) of every cell that queries ask for."""
    rows = np.repeat(np.arange(len(asked)), [len(a) for a in asked])
    cells = np.concatenate([np.asarray(a, np.int64) for a in asked])
    by_query, by_vector = np.argsort(cells, kind="stable"), np.argsort(held, kind="stable")
    rows, cells, held = rows[by_query], cells[by_query], held[by_vector]
    for cell in np.unique(held):
        q = rows[np.searchsorted(cells, cell):np.searchsorted(cells, cell, "right")]
        if len(q):
            yield q, by_vector[np.searchsorted(held, cell):np.searchsorted(held, cell, "right")]


def _fields(queries, vectors, query_id, id):
    q_type = queries.schema[query_id].dataType
    v_type = vectors.schema[id].dataType
    return T.StructType([T.StructField(query_id, q_type), T.StructField(id, v_type),
                         T.StructField("score", T.DoubleType())])


def _tiled_knn(queries, vectors, k, query_id, query_vec, id, vec, by, query_rows,
               vector_rows, cell=None) -> DataFrame:
    """Both sides cut into tiles inside each group; every pair of tiles meets once, by its numbers.

    A group that owns a third of the vectors becomes many tiles, so no task holds more than a tile
    of either side, and each pair of tiles sends k rows per query on. With ``cell``, a number in the
    vectors and an array of numbers in the queries, a query meets only the cells it names.
    """
    kept = [cell] if cell else []
    queries = queries.select(*by, query_id, query_vec, *kept).filter(F.col(query_vec).isNotNull())
    vectors = vectors.select(*by, id, vec, *kept).filter(F.col(vec).isNotNull() & F.col(id).isNotNull())

    def tiles(df, rows, name):
        return df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(name))

    if by:
        counts = tiles(queries, query_rows, "_nq").join(tiles(vectors, vector_rows, "_nv"), by)
        queries, vectors = queries.join(counts, by), vectors.join(counts, by)
    else:       # two numbers
        sizes = {"_nq": tiles(queries, query_rows, "n").first()[0],
                 "_nv": tiles(vectors, vector_rows, "n").first()[0]}
        sizes = {c: F.lit(max(1, n)) for c, n in sizes.items()}
        queries, vectors = queries.withColumns(sizes), vectors.withColumns(sizes)

    def part(key, n):
        return F.pmod(F.xxhash64(key), F.col(n)).cast("int")

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    q = queries.withColumn("_qb", part(query_id, "_nq")).withColumn("_vb", every("_nv")) \
        .drop("_nq", "_nv")
    v = vectors.withColumn("_vb", part(id, "_nv")).withColumn("_qb", every("_nq")).drop("_nq", "_nv")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for dim, qs in left.groupby(left[query_vec].str.len()):
            vs = right[right[vec].str.len() == dim]
            if len(vs):
                parts = _shared_cells(list(qs[cell]), vs[cell].to_numpy()) if cell else None
                q_ids, ids, scores = _block(qs[query_id].to_numpy(), _matrix(qs[query_vec]),
                                            key_array(vs[id]), _matrix(vs[vec]), k, parts)
                out.append(pd.DataFrame({query_id: q_ids, id: ids, "score": scores}))
        return (pd.concat(out) if out
                else pd.DataFrame({query_id: [], id: [], "score": []}))

    keys = [*by, "_qb", "_vb"]
    return (q.groupBy(*keys).cogroup(v.groupBy(*keys))
            .applyInPandas(meet, _fields(queries, vectors, query_id, id)))


def semantic_search(queries: DataFrame, vectors: DataFrame, k: int, *, query_id="query_id",
                    query_vec="query_vec", id="id", vec="embedding", by=(),
                    query_rows=QUERY_ROWS, vector_rows=VECTOR_ROWS) -> DataFrame:
    """Exact top-k by cosine: ``(query_id, id, score, rank)``, the same plan for any number of queries.

    Tiles of queries meet tiles of vectors; ``by`` restricts candidates to rows with equal values.
    Vectors of another length than the query's, null vectors and null ids are no candidates. The
    result, at most k rows per query, is written out: it is the costly step, later steps read it
    repeatedly, and its true size lets the planner broadcast it to the large tables it is joined with.
    """
    by = [by] if isinstance(by, str) else list(by)
    cand = _tiled_knn(queries, vectors, k, query_id, query_vec, id, vec, by, query_rows, vector_rows)
    return materialize(top_per(cand, query_id, [F.desc("score"), F.asc(id)], k), "hits")


def user_search(queries, vectors, k, *, user="user_id", **kw) -> DataFrame:
    """Top-k among the rows of the same user."""
    return semantic_search(queries, vectors, k, by=user, **kw)


def _chance(scores: np.ndarray, bits: int, tables: int) -> float:
    """Mean chance that vectors with these cosines share a bucket in one of the tables."""
    same = (1 - np.arccos(np.clip(scores, -1, 1)) / np.pi) ** bits
    return float(np.mean(1 - (1 - same) ** tables))


def lsh_tables(scores: np.ndarray, bits: int, recall: float) -> int:
    """Fewest tables with which the chance at these cosines is at least ``recall``."""
    most = 1
    while _chance(scores, bits, most) < recall:
        most *= 2
    least = most // 2
    while most - least > 1:
        mid = (least + most) // 2
        least, most = (mid, most) if _chance(scores, bits, mid) < recall else (least, mid)
    return most


def semantic_search_lsh(queries: DataFrame, vectors: DataFrame, k: int, *, dim: int,
                        tables: int | None = None, bits: int | None = None, bucket: int = 512,
                        recall: float = 0.9, sample: int = 256, seed: int = 7,
                        query_id="query_id", query_vec="query_vec", id="id",
                        vec="embedding") -> DataFrame:
    """Approximate top-k: random hyperplane buckets, exact scores inside the buckets.

    Hyperplanes and tables are chosen together. The cosine of the k-th neighbour is measured by the
    exact search of ``sample`` queries, and a number of hyperplanes gets as many tables as bring a
    neighbour that far into a shared bucket with the chance ``recall``; of these choices with buckets
    of ``bucket`` vectors or more the one with the least work is taken, counting a table's copy of a
    row, of either side, as much as ``bucket`` scores. Where no number pays, none is left: one bucket,
    exact.

    Buckets are blocked like any other group, so a crowded bucket is split and only k rows
    per query and block are emitted.
    """
    if tables is None or bits is None:
        some = queries.select(query_id, query_vec).filter(F.size(query_vec) == dim) \
            .orderBy(F.xxhash64(query_id)).limit(sample)
        near = semantic_search(some, vectors, k, query_id=query_id, query_vec=query_vec, id=id, vec=vec)
        found = near.groupBy(query_id).agg(F.min("score").alias("score")).collect()    # of the sample
        scores = np.array([r["score"] for r in found] or [1.0])
        if bits is None:
            n, asked = max(1, vectors.count()), max(1, queries.count())
            most = min(30, max(0, int(np.log2(max(1, n / bucket)))))
            cost = {b: (tables or lsh_tables(scores, b, recall)) * (asked * n / 2 ** b + bucket * (asked + n))
                    for b in range(most + 1)
                    if tables is None or _chance(scores, b, tables) >= recall}
            bits = min(cost, key=cost.get)
        tables = tables or lsh_tables(scores, bits, recall)
    planes = np.random.default_rng(seed).standard_normal((tables, bits, dim))
    weights = 2 ** np.arange(bits)
    step = max(1, 256 // max(1, bits))      # tables whose signs are held at a time

    @F.pandas_udf("array<int>")
    def signatures(col: pd.Series) -> pd.Series:
        mat = np.asarray([np.asarray(v, dtype=np.float64) for v in col])
        if len(mat) == 0:
            return pd.Series([], dtype=object)
        out = np.zeros((len(mat), tables), np.int32)
        for lo in range(0, tables, step):
            some = planes[lo:lo + step]
            signs = (mat @ some.reshape(-1, dim).T > 0).reshape(len(mat), len(some), bits)
            out[:, lo:lo + step] = (signs * weights).sum(axis=2)
        return pd.Series(list(out))

    def bucketed(df, key, col):
        usable = df.select(key, col).filter(F.size(col) == dim)
        return usable.select(key, col, F.posexplode(signatures(col)).alias("_t", "_sig"))

    cand = _tiled_knn(bucketed(queries, query_id, query_vec), bucketed(vectors, id, vec), k,
                      query_id, query_vec, id, vec, ["_t", "_sig"], QUERY_ROWS, VECTOR_ROWS)
    unique = first_per(cand, [query_id, id], [F.desc("score")])
    return top_per(unique, query_id, [F.desc("score"), F.asc(id)], k)


# ---- inverted file ------------------------------------------------------------------------

def _steps(n: int):
    return (slice(lo, lo + STEP_QUERIES) for lo in range(0, n, STEP_QUERIES))


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The best centre of each vector; scores of a step of vectors are held at a time."""
    return np.concatenate([np.zeros(0, np.int64),
                           *(np.argmax(vectors[some] @ centres.T, axis=1) for some in _steps(len(vectors)))])


def _centres(sample: np.ndarray, cells: int, rounds: int, seed: int) -> np.ndarray:
    """Unit centres of ``cells`` groups of unit vectors, balanced: in every round a centre that holds
    more than twice its share is split, in place of the one that holds least."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), cells, replace=False)]
    for turn in range(rounds):
        near = _nearest(sample, centres)
        sizes = np.bincount(near, minlength=cells)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, np.divide(sums, size, out=np.zeros_like(sums), where=size > 0), centres)
        if turn < rounds - 1:
            heavy = np.flatnonzero(sizes > 2 * len(sample) / cells)
            light = np.argsort(sizes, kind="stable")[:len(heavy)]
            for full, empty in zip(heavy, light):
                if sizes[empty] < sizes[full] / 2:
                    centres[empty] = sample[rng.choice(np.flatnonzero(near == full))]
    return centres


class InvertedFile:
    """Cells of vectors around centres, and how far behind the best centre of a query a cell may lie
    for the query to look into it."""

    def __init__(self, centres: np.ndarray, slack: float):
        self.centres, self.slack = centres, slack

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        return _nearest(vectors, self.centres)

    def probes(self, queries: np.ndarray) -> list[np.ndarray]:
        return [np.flatnonzero(row >= row.max() - self.slack)
                for some in _steps(len(queries)) for row in queries[some] @ self.centres.T]


def fit_ivf(queries: DataFrame, vectors: DataFrame, k: int, *, dim: int, cell: int = 256,
            most_rows: int = 50_000, sample: int = 256, recall: float = 0.9, margin: float = 0.03,
            rounds: int = 12, seed: int = 7, query_id="query_id", query_vec="query_vec", id="id",
            vec="embedding") -> InvertedFile:
    """An inverted file fitted on at most ``most_rows`` vectors and ``sample`` queries.

    Both samples are the rows with the smallest hashes of their ids, from the whole tables. There is
    a cell per ``cell`` vectors, at most one per 16 sampled ones; beyond that cells grow with the
    table, and crowded ones are searched in tiles. The exact neighbours of the sampled queries say
    how far their cells lie behind the best one: the slack takes in ``recall`` + ``margin`` of them.
    """
    rows = vectors.select(id, vec).filter((F.size(vec) == dim) & F.col(id).isNotNull())
    n = rows.count()
    some = rows.orderBy(F.xxhash64(id), id).limit(most_rows).select(vec).collect()
    known = _matrix([r[0] for r in some]) if some else np.zeros((0, dim))
    cells = max(1, min(n // cell, len(known) // 16))
    if cells == 1:
        return InvertedFile(np.zeros((1, dim)), 0.0)
    centres = _centres(known, cells, rounds, seed)
    asked = queries.select(query_id, query_vec).filter(F.size(query_vec) == dim) \
        .orderBy(F.xxhash64(query_id), query_id).limit(sample)
    near = semantic_search(asked, rows, k, query_id=query_id, query_vec=query_vec, id=id, vec=vec)
    pairs = near.select(query_id, id).join(asked, query_id).join(rows, id).select(query_vec, vec).collect()
    if not pairs:
        return InvertedFile(centres, 0.0)
    file = InvertedFile(centres, 0.0)
    q, cell_of = _matrix([r[0] for r in pairs]), file.cells(_matrix([r[1] for r in pairs]))
    behind = np.concatenate([s.max(axis=1) - s[np.arange(len(s)), cell_of[some]]
                             for some in _steps(len(q)) for s in [q[some] @ centres.T]])
    return InvertedFile(centres, float(np.quantile(behind, min(1.0, recall + margin), method="higher")) + 1e-9)


def semantic_search_ivf(queries: DataFrame, vectors: DataFrame, k: int, file: InvertedFile | None = None, *,
                        dim: int, query_id="query_id", query_vec="query_vec", id="id", vec="embedding",
                        **fit) -> DataFrame:
    """Approximate top-k: every vector lies in one cell, a query looks into all cells near enough.

    Scores are exact. A vector is copied nowhere. Cells go in shards of ``SHARD_CELLS``, and a query goes
    once to each shard that holds cells of its own, with their numbers; a crowded shard is cut into
    tiles, so no task holds more than a tile of either side.
    """
    names = dict(query_id=query_id, query_vec=query_vec, id=id, vec=vec)
    file = file or fit_ivf(queries, vectors, k, dim=dim, **names, **fit)
    ends = np.arange(SHARD_CELLS, len(file.centres), SHARD_CELLS)

    @F.pandas_udf("int")
    def cell(col: pd.Series) -> pd.Series:
        return pd.Series(file.cells(_matrix(col)) if len(col) else [], dtype="int32")

    @F.pandas_udf("array<array<int>>")
    def probes(col: pd.Series) -> pd.Series:
        found = file.probes(_matrix(col)) if len(col) else []
        return pd.Series([[part.tolist() for part in np.split(x, np.searchsorted(x, ends))] for x in found],
                         dtype=object)

    held = vectors.select(id, vec).filter(F.size(vec) == dim).withColumn("_cell", cell(vec)) \
        .withColumn("_shard", F.floor(F.col("_cell") / SHARD_CELLS).cast("int"))
    asked = queries.select(query_id, query_vec).filter(F.size(query_vec) == dim) \
        .select(query_id, query_vec, F.posexplode(probes(query_vec)).alias("_shard", "_cell")) \
        .filter(F.size("_cell") > 0)
    cand = _tiled_knn(asked, held, k, query_id, query_vec, id, vec, ["_shard"], QUERY_ROWS, VECTOR_ROWS, "_cell")
    return materialize(top_per(cand, query_id, [F.desc("score"), F.asc(id)], k), "hits")


def recall_against(approx: DataFrame, exact: DataFrame, query_id="query_id", id="id"):
    """Share of the exact neighbours that the approximate lists contain."""
    found = exact.join(approx.select(query_id, id).withColumn("_hit", F.lit(1)),
                       [query_id, id], "left")
    return found.agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("recall"))

