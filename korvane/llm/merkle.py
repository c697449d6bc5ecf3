"""Merkle dataset manifest (13): a recursive query climbs from every leaf to the root.

The rows of a group, in key order, are the leaves of a tree; every ``fan`` consecutive nodes become
one until a group has one node, its subroot. The subroots, in group order, form the top tree in
the same way. Each level is written once as node rows that name their parent and their slot in it
(``Manifest.nodes``). ``climb`` is one recursive Spark query over these rows: a state joins its
parent, every leaf folds its own hash with the siblings around it, and the siblings are appended to
its proof. Leaves of one run share all siblings above it, so they climb as one row of at most
``fan`` hashes, and the shared part of their proofs is kept once.

No group is held in one task: positions come from ranges of the sort key, runs are groups of at
most ``fan`` rows, and a node row holds the hashes of one run.

Edge cases: a null in any column hashes as ``-``; a null key sorts first and is a leaf like any
other, a null group is a group of its own and comes first. Rows with the same key are ordered by
their hash, identical rows follow each other, each with its own proof. A lone leaf is its group's
subroot, a lone group's subroot the root; its proof is empty where both hold. An empty table gives
no rows. Texts of any length are hashed as they are. Other columns, whatever their names, are
never read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from korvane.dist import number_rows, position_within
from korvane.session import materialize

FAN = 16
TOP = -1                      # the tree of the subroots
SIZE = 32                     # bytes of a hash
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Spark ends a recursion at a million rows unless told otherwise; a climb has a row per run and level.
UNBOUNDED = ("spark.sql.cteRecursionRowLimit", "-1")


def digest(*parts: Column) -> Column:
    """The hash of texts, as bytes; it goes into other hashes as hex text."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def as_hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def leaf_of(values: list[Column]) -> Column:
    """The hash of a row: each value with its length in bytes, so that no two rows read alike."""
    texts = [v.cast("string") for v in values]
    return digest(*[F.when(t.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts])


@dataclass(frozen=True)
class Manifest:
    """``runs``: the leaves by run (tree, pos, n, keys, leaves, claimed); ``nodes``: the levels
    (tree, level, pos, kids, digest and the parent's up_tree, up_level, up_pos, slot)."""
    runs: DataFrame
    nodes: DataFrame
    fan: int


def _runs(rows: DataFrame, fan: int, *more: str) -> DataFrame:
    """Runs of ``fan`` consecutive rows (tree, n, pos, digest): their hashes in one binary."""
    by = F.floor(F.col("pos") / fan).cast("long")
    found = rows.groupBy("tree", "n", by.alias("run")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "digest", *more))).alias("r"))
    return found.select("tree", "n", F.col("run").alias("pos"), F.unhex(F.array_join(
        F.transform("r", lambda x: F.hex(x["digest"])), "")).alias("kids"),
        *[F.col("r").getField(m).alias(m) for m in more])


def _level(runs: DataFrame, level: int, fan: int, *more: str) -> DataFrame:
    """Node rows of a level; ``n`` becomes the number of nodes that their tree has there."""
    lone = F.col("n") == 1
    return runs.select(
        "tree", F.when(lone, F.lit(0)).otherwise(level).alias("level"), "pos", "kids",
        F.when(lone, F.col("kids")).otherwise(digest(as_hex(F.col("kids")))).alias("digest"),
        F.ceil(F.col("n") / fan).cast("long").alias("n"), *more)


def _tree(rows: DataFrame, fan: int, level: int = 1) -> list[DataFrame]:
    """All levels above ``rows`` (tree, n, pos, digest), each written once; how many there are
    follows from the largest tree."""
    levels = []
    while not rows.isEmpty():
        levels.append(materialize(_level(_runs(rows, fan), level, fan), "nodes"))
        rows, level = _open(levels[-1]), level + 1
    return levels


def _open(nodes: DataFrame) -> DataFrame:
    return nodes.filter("n > 1").select("tree", "n", "pos", "digest")


def _linked(nodes: DataFrame, trees: int, fan: int, *more: str) -> DataFrame:
    """Node rows with their parent: a subroot's lies in the top tree, the root has none."""
    inside = F.col("n") > 1
    place = F.when(inside, F.col("pos")).otherwise(F.col("tree"))
    linked = inside | ((F.col("tree") != TOP) & F.lit(trees > 1))
    return nodes.select(
        "tree", "level", "pos", "kids", "digest",
        F.when(linked, F.when(inside, F.col("tree")).otherwise(TOP)).cast("long").alias("up_tree"),
        F.when(linked, F.when(inside, F.col("level") + 1).otherwise(1)).cast("int").alias("up_level"),
        F.when(linked, F.floor(place / fan)).cast("long").alias("up_pos"),
        F.when(linked, F.pmod(place, F.lit(fan))).cast("int").alias("slot"), *more)


def build(docs: DataFrame, key: str = "doc_id", group: str = "source", columns=COLUMNS,
          claims: dict[str, Column] | None = None, fan: int = FAN) -> Manifest:
    """The manifest of ``docs``. ``claims`` gives other values for some columns, as a reader of a
    changed copy would see them; their hashes are kept next to the leaves for ``climb`` to fold."""
    claims = claims or {}
    seen = [claims.get(c, F.col(c)) for c in columns]
    same = reduce(lambda a, b: a & b, [v.eqNullSafe(F.col(c)) for c, v in claims.items()], F.lit(True))
    leaves = docs.select(F.col(group).cast("string").alias("grp"), F.col(key).alias("key"),
                         leaf_of([F.col(c) for c in columns]).alias("digest"),
                         F.when(~same, leaf_of(seen)).alias("claimed"))
    placed = materialize(position_within(materialize(leaves, "leaves"), "grp", ["key", "digest"]),
                         "placed")
    sizes = placed.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    trees = materialize(number_rows(sizes, "grp", "tree", start=0), "trees")
    count = trees.count()
    rows = placed.join(trees.withColumnRenamed("grp", "g"), F.col("grp").eqNullSafe(F.col("g"))) \
        .select("tree", "n", "pos", "key", "digest", "claimed")
    runs = materialize(_level(_runs(rows, fan, "key", "claimed"), 1, fan, "key", "claimed"), "runs")
    levels = [runs.drop("key", "claimed"), *_tree(_open(runs), fan, 2)]
    if count > 1:
        tops = reduce(DataFrame.unionByName, levels).filter("n = 1").select(
            F.lit(TOP).cast("long").alias("tree"), F.lit(count).cast("long").alias("n"),
            F.col("tree").alias("pos"), "digest")
        levels += _tree(tops, fan)
    nodes = materialize(_linked(reduce(DataFrame.unionByName, levels), count, fan), "manifest")
    return Manifest(_linked(runs, count, fan, "key", "claimed"), nodes, fan)


def _around(kids: str, slot: str) -> tuple[str, str]:
    """The hashes left and right of a slot."""
    return (f"substring({kids}, 1, {SIZE} * {slot})", f"substring({kids}, {SIZE} * {slot} + {SIZE + 1})")


def _folded(own: str, left: str, right: str) -> str:
    return f"unhex(sha2(concat(lower(hex({left})), lower(hex({own})), lower(hex({right}))), 256))"


LEFT, RIGHT = _around("n.kids", "c.slot")
OWN_LEFT, OWN_RIGHT = _around("kids", "i")
CLIMB = f"""
WITH RECURSIVE climb AS (
    SELECT key, kids, transform(claimed, (x, i) -> CASE WHEN level = 0
            THEN coalesce(x, kids) ELSE {_folded("coalesce(x, substring(kids, %d * i + 1, %d))"
                                                 % (SIZE, SIZE), OWN_LEFT, OWN_RIGHT)} END) AS folded,
        CAST('' AS BINARY) AS above, digest AS subroot, digest, up_tree, up_level, up_pos, slot
    FROM {{runs}}
    UNION ALL
    SELECT c.key, c.kids, transform(c.folded, x -> {_folded("x", LEFT, RIGHT)}),
        concat(c.above, {LEFT}, {RIGHT}), CASE WHEN n.tree = {TOP} THEN c.subroot ELSE n.digest END,
        n.digest, n.up_tree, n.up_level, n.up_pos, n.slot
    FROM climb c JOIN {{nodes}} n
        ON c.up_tree = n.tree AND c.up_level = n.level AND c.up_pos = n.pos)
SELECT key, kids, folded, above, subroot, digest AS root FROM climb WHERE up_tree IS NULL"""


def climb(manifest: Manifest) -> DataFrame:
    """(key, leaf, siblings, folded, subroot, root) of every leaf, hashes as bytes; ``siblings`` are
    those of its levels one after the other, left to right."""
    spark = manifest.nodes.sparkSession
    before = spark.conf.get(UNBOUNDED[0])
    spark.conf.set(*UNBOUNDED)
    try:
        done = materialize(spark.sql(CLIMB, runs=manifest.runs, nodes=manifest.nodes), "climbed")
    finally:
        spark.conf.set(UNBOUNDED[0], before)
    each = done.select("kids", "above", "subroot", "root", F.posexplode(F.arrays_zip("key", "folded")))
    left, right = _around("kids", "pos")
    return each.select("col.key", F.expr(f"substring(kids, {SIZE} * pos + 1, {SIZE})").alias("leaf"),
                       F.expr(f"concat({left}, {right}, above)").alias("siblings"),
                       "col.folded", "subroot", "root")


def report(docs: DataFrame, key: str = "doc_id", **names) -> DataFrame:
    """One row per document: leaf, subroot, root, the hash of its proof, what its claimed values
    fold to, and whether that is the root."""
    found = climb(build(docs, key, **names))
    return found.select(F.col("key").alias(key),
                        *[as_hex(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")],
                        F.sha2(as_hex(F.col("siblings")), 256).alias("proof_sha256"),
                        as_hex(F.col("folded")).alias("folded_root"),
                        (F.col("folded") == F.col("root")).alias("verified"))


UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(key: str = "doc_id", text: str = "text") -> dict[str, Column]:
    """The tampering of the check: every fifth key, by checksum, has its text in small letters."""
    fifth = F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0
    return {text: F.when(fifth, F.translate(text, UPPER, SMALL)).otherwise(F.col(text))}


# DuckDB has no crc32: the bits of the key's digits are folded one after the other
CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
    range(1, length(doc_id::VARCHAR) + 1), lambda i: [ord(substr(doc_id::VARCHAR, i, 1))::BIGINT, -1, -1, -1, -1, -1,
    -1, -1, -1]))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1
    THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"""


def _sql_leaf(text: str) -> str:
    parts = " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"
                        for c in ("doc_id", "source", "lang", "n_chars", text))
    return f"sha256({parts})"


SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, {_sql_leaf("text")} AS leaf,
    CASE WHEN {CRC} % 5 = 0 THEN {_sql_leaf(f"translate(text, '{UPPER}', '{SMALL}')")}
    ELSE {_sql_leaf("text")} END AS claimed FROM documents),
l AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER () AS k,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
up AS (SELECT tree, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM l
    UNION ALL
    SELECT tree, level + 1, pos // {FAN}, sha256(string_agg(h, '' ORDER BY pos)), (n + {FAN - 1}) // {FAN}
    FROM up WHERE n > 1 GROUP BY tree, level, pos // {FAN}, n),
top AS (SELECT -1 AS tree, 0 AS level, tree AS pos, h, count(*) OVER () AS n FROM up WHERE n = 1
    UNION ALL
    SELECT tree, level + 1, pos // {FAN}, sha256(string_agg(h, '' ORDER BY pos)), (n + {FAN - 1}) // {FAN}
    FROM top WHERE n > 1 GROUP BY tree, level, pos // {FAN}, n),
runs AS (SELECT tree, level, n, pos // {FAN} AS run, list(h ORDER BY pos) AS hs
    FROM (FROM up UNION ALL FROM top) GROUP BY tree, level, n, pos // {FAN}),
c AS (SELECT k, tree, 0 AS level, pos, claimed AS f, '' AS proof FROM l
    UNION ALL
    SELECT k, CASE WHEN n > 1 THEN c.tree ELSE -1 END, CASE WHEN n > 1 THEN c.level + 1 ELSE 0 END,
        CASE WHEN n > 1 THEN pos // {FAN} ELSE c.tree END,
        CASE WHEN n > 1 THEN sha256(array_to_string(hs[:pos % {FAN}], '') || f
            || array_to_string(hs[pos % {FAN} + 2:], '')) ELSE f END,
        CASE WHEN n > 1 THEN proof || array_to_string(hs[:pos % {FAN}], '')
            || array_to_string(hs[pos % {FAN} + 2:], '') ELSE proof END
    FROM c JOIN runs r ON r.tree = c.tree AND r.level = c.level AND r.run = c.pos // {FAN}
    WHERE n > 1 OR c.tree >= 0)
SELECT doc_id, leaf, u.h AS subroot, t.h AS root, sha256(proof) AS proof_sha256, f AS folded_root,
    f = t.h AS verified
FROM l JOIN c USING (k) JOIN top t ON t.n = 1 AND c.tree = -1 AND c.level = t.level
    JOIN up u ON u.n = 1 AND u.tree = l.tree"""
