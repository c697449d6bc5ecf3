"""Merkle manifest (13) against a plain version, and its edge cases."""

import hashlib
import zlib
from collections import defaultdict

from korvane.llm import merkle

SCHEMA = ("doc_id long, source string, lang string, n_chars long, text string, key string, pos int, "
          "tree int, digest string, n int, kids string, grp int")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain(rows, fan=16):
    """(doc_id, leaf, subroot, root, proof, folded) of every row."""
    groups = defaultdict(list)
    for i, s, lang, n, text in rows:
        own = leaf((i, s, lang, n, text))
        changed = text is not None and i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        groups[s].append((i, own, leaf((i, s, lang, n, text.translate(LOWER))) if changed else own))

    def climb(hashes, at, own):
        proof = ""
        while len(hashes) > 1:
            run = hashes[at // fan * fan:at // fan * fan + fan]
            left, right = "".join(run[:at % fan]), "".join(run[at % fan + 1:])
            own, proof = sha(left + own + right), proof + left + right
            hashes = [sha("".join(hashes[k:k + fan])) for k in range(0, len(hashes), fan)]
            at //= fan
        return hashes[0], own, proof

    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in groups.values():
        g.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    tops = [climb([x[1] for x in groups[s]], 0, "")[0] for s in order]
    out = []
    for k, s in enumerate(order):
        for at, (i, own, claimed) in enumerate(groups[s]):
            sub, folded, proof = climb([x[1] for x in groups[s]], at, claimed)
            root, folded, more = climb(tops, k, folded)
            out.append((i, own, sub, root, sha(proof + more), folded, folded == root))
    return sorted(out, key=repr)


def compare(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "x", 1, 2, "y", 3, "z", 4) for r in rows], SCHEMA).repartition(parts)
    got = merkle.report(df, claims=merkle.lowered())
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows)


def test_three_levels_and_many_sources(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 60:02d}", "en", i, f"Text {i} É") for i in range(700)]
    compare(spark, rows)


def test_nulls_ties_repeats_and_long_texts(spark):
    rows = [(None, None, None, None, None), (None, "a", "x", 1, "Ab"), (None, "a", "x", 1, "Ab"),
            (4, "a", None, 0, ""), (4, "a", None, 0, "other"), (4, "a", None, 0, ""), (5, "", "en", -1, None),
            (-7, "Ä", "en", 2, "AB" * 100_000), (9, None, "vi", 3, "1:2-"), (10, "lone", "en", 1, "X")]
    rows += [(i, "a", "en", 1, f"T{i}") for i in range(20, 37)]
    compare(spark, rows)


def test_one_source_one_row_and_none(spark):
    compare(spark, [(i, "s", "en", 1, f"T{i}") for i in range(17)])
    compare(spark, [(0, None, "en", 1, "T")])
    compare(spark, [(1, "a", "en", 1, "T"), (2, "b", "en", 1, "U")])
    assert merkle.report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_parents_and_proofs(spark):
    docs = spark.createDataFrame([(i, f"s{i % 2}", "en", 1, f"t{i}") for i in range(40)],
                                 "doc_id long, source string, lang string, n_chars long, text string")
    found = merkle.build(docs, fan=4)
    nodes = {(r.tree, r.level, r.pos): r for r in found.nodes.collect()}
    roots = [r for r in nodes.values() if r.up_tree is None]
    assert len(roots) == 1 and roots[0].tree == merkle.TOP
    for r in nodes.values():
        if r.up_tree is not None:
            up = nodes[r.up_tree, r.up_level, r.up_pos]
            assert bytes(up.kids)[32 * r.slot:32 * r.slot + 32] == bytes(r.digest)
    before = spark.conf.get(merkle.UNBOUNDED[0])
    rows = merkle.climb(found).collect()
    assert spark.conf.get(merkle.UNBOUNDED[0]) == before
    assert len(rows) == 40 and all(bytes(r.folded) == bytes(r.root) for r in rows)
    assert {len(r.siblings) // 32 for r in rows} == {3 + 3 + 1 + 1, 3 + 0 + 1 + 1}
