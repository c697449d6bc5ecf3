"""N-gram Jaccard join (10): universe-partition pigeonhole.

Hashing cuts the universe of word n-grams into the segments of a size band; two sets that reach
the threshold differ in at most H elements, so of a set's non-empty segments at most H differ
from its partner's. Segment subsets are counted over all documents; only sets with enough
segments that some other set has too stay ("alive"). For these also the subsets with one element
deleted are indexed: a segment probed that way only misses partners that differ there twice. Of a
single element nothing is left to index, so such a segment is probed whole only.
Segments and levels are then chosen per set by what their buckets cost, until they must catch
every partner, and all links are verified on the whole sets.

Edge cases: a null or empty text has an empty set and no links; a text with fewer words than a
shingle is one shingle. Documents with equal sets are one node, so copies never meet in pairs;
repeated rows are such copies, and each input row gets its row. Null ids are kept, never the
component's name unless the whole component has none. Empty tables give no rows. Other columns
are never read. Shingles are 64-bit hashes and a set is named by 128 bits.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from korvane.session import discard, materialize, release

from . import arrays as A
from .bitmaps import Bitmap, build
from .links import cluster, rare_pairs

BITS = 26                 # eight megabytes, whatever the number of keys
SLICE_BYTES = 512 << 10   # a slice's signatures take a hundred times its text


@dataclass(frozen=True)
class Scheme:
    """Size bands and their segments for a Jaccard threshold of ``p / q``."""
    n: int = 4
    p: int = 85
    q: int = 100
    spare: float = 1.25   # segments per segment that the pigeonhole needs
    edges: np.ndarray = field(init=False, compare=False)
    segments: np.ndarray = field(init=False, compare=False)

    def __post_init__(self):
        edges = [max(1, -(-self.p // max(1, self.q - self.p)))]
        growth = max(1.6, 1.05 * self.q / self.p)
        while edges[-1] < 1 << 40:
            edges.append(max(edges[-1] + 2, int(edges[-1] * growth)))
        edges = np.array(edges, np.int64)
        differ = self.differ(2 * (edges[1:] - 1))
        object.__setattr__(self, "edges", edges)
        object.__setattr__(self, "segments", np.ceil((differ + 1) * self.spare).astype(np.int64))

    def differ(self, both):
        """Most elements in one set only, for two linked sets with so many elements together."""
        return both * (self.q - self.p) // (self.q + self.p)

    def plans(self, sizes: np.ndarray):
        """(set, band) of all bands a set takes part in: its own and, if near it, the next."""
        band = np.searchsorted(self.edges, sizes, "right") - 1
        own = np.flatnonzero(band >= 0)
        up = own[self.q * sizes[own] >= self.p * self.edges[band[own] + 1]]
        return np.concatenate([own, up]), np.concatenate([band[own], band[up] + 1])

    def most_differ(self, sizes: np.ndarray, band: np.ndarray) -> np.ndarray:
        partner = np.minimum(self.edges[band + 1] - 1, sizes * self.q // self.p)
        return self.differ(sizes + partner)


def shingle_sets(part: pa.RecordBatch, column: str, n: int, hasher: A.RangeHash):
    """Distinct shingles sorted by (text, hash), the text of each, and the set sizes."""
    data, offsets = A.text_bytes(part.column(column))
    data = A.LOWER[data]
    starts, ends = A.ranges(A.SPACE_SPLIT[data], offsets)
    texts, rows = A.owner(starts, offsets), part.num_rows
    hashes = hasher(data, starts, ends)
    g, first = A.grams(hashes, texts, n)
    all_g, all_t = [g], [texts[first]]
    words = np.bincount(texts, minlength=rows)
    for size in np.unique(words[(words > 0) & (words < n)]):
        g, first = A.grams(hashes, texts, int(size))
        short = words[texts[first]] == size
        all_g.append(g[short]), all_t.append(texts[first][short])
    g, t = np.concatenate(all_g), np.concatenate(all_t)
    order = A.grouped(t, g)
    g, t = g[order], t[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (t[1:] != t[:-1])
    g, t = g[new], t[new]
    return g, t, np.bincount(t, minlength=rows)


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def names(g: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """128 bits per set, as two columns."""
    one = A.mix(_sums(A.mix(g), sizes) + sizes.astype(np.uint64))
    two = A.mix(_sums(A.mix(g ^ A.BASE), sizes) + A.BASE)
    return np.stack([one, two], 1)


def signatures(g, sizes, rows: np.ndarray, scheme: Scheme, deletions: bool = True):
    """Per (set, band): plan arrays; per non-empty segment: its plan, number, key and elements.

    A set with no more non-empty segments than may differ ("lone") is indexed by its single
    elements as well (segment -1): a partner that shares none of its segments is such a set too.
    A partner that is not shares a segment with it, so lone sets have their segments like others.
    """
    begin = np.cumsum(sizes) - sizes
    at, band = scheme.plans(sizes[rows])
    doc = rows[at]
    n = sizes[doc]
    plan = np.repeat(np.arange(len(doc)), n)
    local = np.arange(len(plan)) - np.repeat(np.cumsum(n) - n, n)
    element = g[begin[doc][plan] + local]
    segment = (A.mix(element ^ np.uint64(0x5EED)) % scheme.segments[band][plan].astype(np.uint64)) \
        .astype(np.int64)
    order = np.argsort(plan * (int(segment.max(initial=0)) + 1) + segment)
    element, segment, plan = element[order], segment[order], plan[order]
    new = np.ones(len(plan), bool)
    new[1:] = (plan[1:] != plan[:-1]) | (segment[1:] != segment[:-1])
    head = np.flatnonzero(new)
    counts = np.diff(np.append(head, len(plan)))
    part = A.mix(element + A.BASE)
    sums = _sums(part, counts)
    seg_plan, seg = plan[head], segment[head]
    salt = A.mix((band[seg_plan].astype(np.uint64) << np.uint64(40)) + seg.astype(np.uint64))
    keys = A.mix(sums ^ salt)
    filled = np.bincount(seg_plan, minlength=len(doc))
    may = scheme.most_differ(n, band)
    lone = filled <= may
    group = np.repeat(np.arange(len(head)), counts)
    dels = A.mix((sums[group] - part) ^ salt[group]) if deletions else None
    one = counts == 1
    single = A.mix(element ^ A.mix(band[plan].astype(np.uint64) + np.uint64(77)))
    return {"doc": doc, "band": band, "filled": filled, "may": may, "lone": lone,
            "seg_plan": seg_plan, "seg": seg, "key": keys, "plan": plan, "group": group,
            "del": dels, "single": single, "one": one,
            "ones": np.bincount(seg_plan[one], minlength=len(doc))}


def key_rows(docs: DataFrame, text_col: str, scheme: Scheme) -> DataFrame:
    """(key, name): every segment subset of every different set of a batch."""
    def run(batches):
        hasher = A.RangeHash()
        for batch in batches:
            for part in A.slices(batch, "_text", SLICE_BYTES):
                g, _, sizes = shingle_sets(part, "_text", scheme.n, hasher)
                name = names(g, sizes)
                _, rows = np.unique(name[:, 0], return_index=True)
                s = signatures(g, sizes, rows, scheme, False)
                lone = s["lone"][s["plan"]]
                keys = np.concatenate([s["key"], s["single"][lone]])
                plan = np.concatenate([s["seg_plan"], s["plan"][lone]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(A.signed(keys)), pa.array(A.signed(name[s["doc"][plan], 0]))],
                    names=["key", "name"])

    return docs.select(F.col(text_col).alias("_text")).mapInArrow(run, "key long, name long")


SEGMENT = pa.struct([("k", pa.int64()), ("b", pa.int32()), ("g", pa.int32()), ("one", pa.bool_())])
PLAN = pa.struct([("b", pa.int32()), ("filled", pa.int32()), ("ones", pa.int32()),
                  ("lone", pa.bool_())])


def _lists(has: np.ndarray, row: np.ndarray, kind: pa.DataType, columns: list) -> pa.Array:
    """A list per row from values that name their row; null for rows that have no lists."""
    order = np.argsort(row, kind="stable")
    ends = np.zeros(len(has) + 1, np.int32)
    np.cumsum(np.bincount(row, minlength=len(has)), out=ends[1:])
    if pa.types.is_struct(kind):
        fields = [kind.field(i) for i in range(kind.num_fields)]
        values = pa.StructArray.from_arrays(
            [pa.array(c[order].astype(f.type.to_pandas_dtype()), f.type) for c, f in zip(columns, fields)],
            fields=fields)
    else:
        values = pa.array(columns[0][order], kind)
    return pa.ListArray.from_arrays(pa.array(ends), values, mask=pa.array(~has))


def alive_sets(docs: DataFrame, id_col: str, text_col: str, scheme: Scheme, shared) -> DataFrame:
    """A row per document; of sets that may have a partner also the plans, keys and elements."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        hasher, present = A.RangeHash(), Bitmap(shared)
        for batch in batches:
            for part in A.slices(batch, "_text", SLICE_BYTES):
                rows = part.num_rows
                g, _, sizes = shingle_sets(part, "_text", scheme.n, hasher)
                name = names(g, sizes)
                _, first = np.unique(name[:, 0], return_index=True)
                s = signatures(g, sizes, first, scheme)
                hits = np.bincount(s["seg_plan"][present(s["key"])], minlength=len(s["doc"]))
                singles = np.bincount(s["plan"][present(s["single"])], minlength=len(s["doc"]))
                alive = np.where(s["lone"], (singles > 0) | (hits > 0),
                                 hits >= s["filled"] - s["may"])
                doc, band, lone = s["doc"], s["band"], s["lone"]
                has = np.zeros(rows, bool)
                has[doc[alive]] = True
                at = np.flatnonzero(alive)
                seg = np.flatnonzero(alive[s["seg_plan"]])
                sole = np.flatnonzero((alive & lone)[s["plan"]])
                gone = np.flatnonzero(alive[s["plan"]] & ~s["one"][s["group"]])
                of_seg, of_sole, of_gone = s["seg_plan"][seg], s["plan"][sole], s["plan"][gone]
                no = np.zeros(len(sole), bool)
                segs = _lists(has, np.concatenate([doc[of_sole], doc[of_seg]]), SEGMENT, [
                    A.signed(np.concatenate([s["single"][sole], s["key"][seg]])),
                    np.concatenate([band[of_sole], band[of_seg]]),
                    np.concatenate([no - 1, s["seg"][seg]]), np.concatenate([no, s["one"][seg]])])
                dels = _lists(has, doc[of_gone], SEGMENT, [
                    A.signed(s["del"][gone]), band[of_gone], s["seg"][s["group"][gone]],
                    np.zeros(len(gone), bool)])
                plans = _lists(has, doc[at], PLAN, [band[at], s["filled"][at], s["ones"][at], lone[at]])
                owner = np.repeat(np.arange(rows), sizes)
                mine = np.flatnonzero(has[owner])
                elements = _lists(has, owner[mine], pa.int64(), [A.signed(g[mine])])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array([x.tobytes() for x in name], pa.binary()),
                     pa.array(sizes, pa.int64()), plans, segs, dels, elements],
                    names=["id", "h", "node", "n", "plans", "segs", "dels", "elements"])

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"),
                       A.text_hash(text_col).alias("_h")).mapInArrow(
        run, f"id {id_type}, h long, node binary, n long, "
             "plans array<struct<b:int,filled:int,ones:int,lone:boolean>>, "
             "segs array<struct<k:long,b:int,g:int,one:boolean>>, "
             "dels array<struct<k:long,b:int,g:int,one:boolean>>, elements array<long>")


def bucket_rows(sets: DataFrame, scheme: Scheme) -> DataFrame:
    """Rows for ``cluster``, written: probes chosen by cost, so that they must catch every partner."""
    full = sets.select("node", "n", F.explode("segs").alias("s"), F.lit(True).alias("full"))
    less = sets.select("node", "n", F.explode("dels").alias("s"), F.lit(False).alias("full"))
    rows = full.union(less).select("node", "n", "s.*", "full")
    bucket = W.partitionBy("k")          # one shuffle; counts joined to the rows would take three
    rows = materialize(rows.withColumns({"n_full": F.count_if("full").over(bucket),
                                         "n_all": F.count("k").over(bucket)})
                       .filter("n_full > 0 and n_all > 1"), "shared")
    release(sets.sparkSession)
    exact = F.sum(F.when(F.col("full"), F.col("n_full") - 1).otherwise(0))
    one_off = F.sum(F.when(F.col("full"), F.col("n_all") - F.col("n_full"))
                    .otherwise(F.col("n_full")))
    costs = rows.filter("g >= 0").groupBy("node", "n", "b", "g") \
        .agg(exact.alias("exact"), one_off.alias("more"), F.max("one").alias("one"))
    # a segment that no bucket lists costs nothing at level 2 and so gives two units; one element
    # gives one unit, as a partner may have nothing there and so no key
    plans = sets.select("node", F.explode("plans").alias("p")) \
        .select("node", "p.b", (2 * F.col("p.filled") - F.col("p.ones")).alias("all"))
    both = W.partitionBy("node", "b")
    exact = F.struct(F.lit(1).alias("level"), F.col("exact").alias("cost"))
    more = F.struct(F.lit(2).alias("level"), F.greatest("exact", "more").alias("cost"))
    listed = F.sum(F.when(F.col("one"), 1).otherwise(2)).over(both)
    units = costs.withColumn("listed", listed).select(
        "node", "n", "b", "g", "listed", F.explode(
            F.when(F.col("one"), F.array(exact)).otherwise(F.array(exact, more)))
        .alias("u")).select("node", "n", "b", "g", "listed", "u.*")
    order = both.orderBy("cost", "level", "g")
    differ = F.floor(2 * F.col("n") * (scheme.q - scheme.p) / (scheme.q + scheme.p))
    chosen = (units.withColumn("turn", F.row_number().over(order)).join(plans, ["node", "b"])
              .filter(F.col("turn") <= differ + 1 - (F.col("all") - F.col("listed")))
              .groupBy("node", "b", "g").agg(F.max("level").alias("level")))
    shared, chosen = rows, materialize(chosen, "chosen")
    rows = rows.join(chosen, ["node", "b", "g"], "left")
    level = F.when(F.col("g") < 0, F.lit(1)).when(F.col("full") | (F.col("level") == 2),
                                                  F.col("level"))
    rows = materialize(rows.select(F.col("k").alias("bucket"), "node", F.col("n").alias("size"), "full",
                                   F.coalesce(level, F.lit(0)).alias("level")), "rows")
    discard(shared, chosen)
    return rows


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            scheme: Scheme = Scheme(), bits: int = BITS) -> DataFrame:
    """(id, h, n, first) per row; ``first`` (unknown, id, h) is the component's first document.

    It is null for a document that has no other in its component.
    """
    keys = key_rows(docs, text_col, scheme).groupBy("key") \
        .agg(F.min("name").alias("lo"), F.max("name").alias("hi")).filter("lo <> hi").select("key")
    shared = build(keys, "key", bits)
    release(docs.sparkSession)
    wide = materialize(alive_sets(docs, id_col, text_col, scheme, shared), "sets")
    sets = materialize(
        wide.filter("plans is not null").groupBy("node")
        .agg(F.any_value("n").alias("n"), F.any_value("plans").alias("plans"),
             F.any_value("segs").alias("segs"), F.any_value("dels").alias("dels"),
             F.any_value("elements").alias("elements")), "alive")
    base = materialize(wide.select("id", "h", "node", "n"), "documents")
    discard(wide)
    release(docs.sparkSession)
    elements = sets.select("node", "elements")
    own = F.transform(F.filter("plans", lambda p: ~p["lone"]), lambda p: p["filled"])
    keys = sets.select("node", "n", F.array_min(own).alias("filled"),
                       F.transform("segs", lambda x: x["k"]).alias("keys"),
                       F.exists("plans", lambda p: p["lone"]).alias("lone"))

    def test(pairs: DataFrame) -> DataFrame:
        """Pairs that share too few segments go on these alone, the others meet their elements."""
        both = pairs.join(keys.toDF("a", "na", "fa", "ka", "la"), "a") \
            .join(keys.toDF("b", "nb", "fb", "kb", "lb"), "b")
        least = F.least("fa", "fb") - differ(F.col("na"), F.col("nb"))
        some = materialize(both.filter(F.col("la") | F.col("lb") | (
            F.size(F.array_intersect("ka", "kb")) >= least)).select("a", "b"), "likely")
        both = some.join(elements.toDF("a", "ea"), "a").join(elements.toDF("b", "eb"), "b")
        same = F.size(F.array_intersect("ea", "eb"))
        return both.filter(scheme.q * same >= scheme.p * (F.size("ea") + F.size("eb") - same))

    def sizes(large, small):
        return scheme.q * small >= scheme.p * large

    def differ(one, two):
        return F.floor((one + two) * (scheme.q - scheme.p) / (scheme.q + scheme.p))

    labels = cluster(bucket_rows(sets, scheme), test, sizes, stars=1,
                     narrow=lambda members: rare_pairs(members, elements, scheme.p, scheme.q))
    # classes of one document with no link have no entry here
    place = F.struct(F.col("id").isNull().alias("unknown"), "id", "h")
    nodes = base.filter("n > 0").groupBy("node").agg(F.min(place).alias("least"),
                                                     F.count(F.lit(1)).alias("copies"))
    nodes = nodes.join(labels, "node", "left").filter("copies > 1 or comp is not null")
    nodes = materialize(nodes.withColumn("comp", F.coalesce("comp", "node")), "classes")
    least = nodes.groupBy("comp").agg(F.min("least").alias("first"))
    names_ = materialize(nodes.join(materialize(least, "least"), "comp").select("node", "first"),
                         "names")
    return base.select("id", "h", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")) \
        .join(names_, "node", "left").select("id", "h", "n", "first")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         scheme: Scheme = Scheme()) -> DataFrame:
    """One row per document: its id, the size of its set and its component's smallest id."""
    return classes(docs, id_col, text_col, scheme).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.coalesce("first.id", "id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             scheme: Scheme = Scheme()) -> DataFrame:
    """The first document of every component, with all its columns; repeated rows become one."""
    rows = classes(docs, id_col, text_col, scheme).filter("first is not null")
    first = (F.col("first.id").eqNullSafe(F.col("id"))) & (F.col("first.h") == F.col("h"))
    decided = materialize(rows.groupBy("id", "h").agg(F.max(first).alias("stays"),
                                                      F.count("h").alias("times")), "decided")
    marked = A.on_document(A.packed(docs, id_col, text_col), decided, "left")
    single = marked.filter("stays is null or (stays and times = 1)").select("d")
    repeated = marked.filter("stays and times > 1").dropDuplicates(["id", "h"]).select("d")
    return single.union(repeated).select(*[F.col(f"d.`{c}`").alias(c) for c in docs.columns])
