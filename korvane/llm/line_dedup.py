"""Line dedup (2): segment-partition edit join.

Two lines link when at most ``tau`` edits (by the shorter one's length) turn one into the other. A
line of length l is cut into tau + 1 segments; within tau edits one of them stays intact, so a
longer or equal line has it as a substring at one of the few starts that its length allows. Both
kinds of keys, a dozen longs per different line of a slice, are hashed at once from prefix sums and
written with the line; keys that two different lines have and one of them is indexed under are kept
by one count over all keys, so rows and shuffles grow with the lines. What meets in these buckets is
verified by a banded bit-parallel edit distance over many pairs at a time. A class is a connected
component; its first line by (document, line) stays and the others go.

Edge cases: lines of fewer than ``Rule.least`` characters allow no edit, so only equal ones link, and
those without a letter, digit or character beyond ASCII are never compared or removed; so empty
lines stay. A null or empty text has no lines to compare and stays as it is. Rows with the same id
and text are one document and get the same result; of equal lines of different documents with the
same id the order of the texts' hashes decides. Null ids come first. Lines of more than ``BLOCK``
characters are hashed piece by piece instead of from prefix sums, which bounds memory. Empty tables
give no rows. Other columns are passed on by ``drop_lines``, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from korvane.session import materialize, release

from .arrays import (ALNUM_SPLIT, RangeHash, mix, on_document, owner, packed, signed, slices, text_bytes,
                     text_hash)
from .bitmaps import Bitmap, build
from .links import cluster, near_pairs

BITS = 26
CELLS = 1 << 20           # characters of one side in a block of pairs
BLOCK = 1 << 19           # characters whose prefix sums are held at once
BINS = 64                 # classes of letters that are counted before a pair's distance
GRAM = 4                  # letters of the grams that keep variants of one line apart


@dataclass(frozen=True)
class Rule:
    least: int = 24       # shorter lines must be equal
    long: int = 64        # from here on two edits are allowed, below one

    def tau(self, length: int) -> int:
        return 0 if length < self.least else 1 if length < self.long else 2


def cuts(length: int, tau: int) -> list[tuple[int, int]]:
    """(start, length) of the tau + 1 even segments, the longer ones last."""
    size, more = divmod(length, tau + 1)
    short = tau + 1 - more
    return [(i * size + max(0, i - short), size + (i >= short)) for i in range(tau + 1)]


def places(n: int, rule: Rule) -> np.ndarray:
    """(start, length, indexed length, segment) of a line's keys; the tau + 1 it is indexed under first.

    Under the others a line no longer than this one, within its edits, may be indexed. Their starts
    are those at which segment i can stand if the edits left of it are fewer than its number and
    those right of it fewer than the segments there.
    """
    own = [(start, size, n, i) for i, (start, size) in enumerate(cuts(n, rule.tau(n)))]
    found = dict.fromkeys(own)
    for length in range(n, rule.least - 1, -1):
        tau, gap = rule.tau(length), n - length
        if gap > tau:       # shorter lines allow no more edits, so the gap stays too wide
            break
        for i, (start, size) in enumerate(cuts(length, tau)):
            lo = max(start - i, start + gap - (tau - i), 0)
            hi = min(start + i, start + gap + (tau - i), n - size)
            found.update(dict.fromkeys((at, size, length, i) for at in range(lo, hi + 1)))
    return np.array(list(found), np.int64)


def _code_points(data: np.ndarray) -> np.ndarray:
    text = data.tobytes().decode("utf-8", "surrogatepass")
    return data if len(text) == len(data) else np.frombuffer(
        text.encode("utf-32-le", "surrogatepass"), np.uint32)


def line_keys(code: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: Rule,
              hasher: RangeHash) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all lines, given as ascending ranges of characters, and how many each has."""
    of_length = {int(n): places(int(n), rule) for n in np.unique(ends - starts)}
    keys, counts, lo = [np.zeros(0, np.uint64)], [], 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + BLOCK, "right")))
        block = [of_length[int(n)] for n in ends[lo:hi] - starts[lo:hi]]
        counts += map(len, block)
        many = np.concatenate(block)
        at = many[:, 0] + np.repeat(starts[lo:hi], [len(x) for x in block])
        to = at + many[:, 1]
        out = np.zeros(len(many), np.uint64)
        short = many[:, 2] <= BLOCK                     # by the indexed line, so both sides agree
        if short.any():
            base = starts[lo]
            out[short] = hasher(code[base:ends[hi - 1]], at[short] - base, to[short] - base)
        for i in np.flatnonzero(~short):
            out[i] = xxhash.xxh3_64_intdigest(code[at[i]:to[i]].astype(np.uint32).tobytes())
        keys.append(mix(out ^ mix((many[:, 2] * 8 + many[:, 3]).astype(np.uint64))))
        lo = hi
    return np.concatenate(keys), np.array(counts, np.int64)


def _keys(line: str, rule: Rule) -> np.ndarray:
    code = _code_points(np.frombuffer(line.encode("utf-8", "surrogatepass"), np.uint8))
    return line_keys(code, np.array([0]), np.array([len(code)]), rule, RangeHash())[0]


def index_keys(line: str, rule: Rule) -> list[int]:
    return _keys(line, rule)[:rule.tau(len(line)) + 1].tolist()


def probe_keys(line: str, rule: Rule) -> list[int]:
    """Keys under which a line no longer than this one, within its edits, may be indexed."""
    return _keys(line, rule).tolist()


class Lines:
    """The compared lines of a slice of texts: row, number, range of characters and of bytes."""

    def __init__(self, column: pa.Array, rule: Rule):
        data, offsets = text_bytes(column)
        self.raw, self.code = data.tobytes(), _code_points(data)
        first = np.arange(len(data) + 1)                  # the byte where each character starts
        if len(self.code) != len(data):
            first = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
            offsets = np.searchsorted(first, offsets)
        breaks = np.flatnonzero(self.code == 10)
        of = owner(breaks, offsets)
        head = np.searchsorted(breaks, offsets[:-1])      # each text's first break
        row = np.concatenate([np.arange(len(offsets) - 1), of])
        number = np.concatenate([np.zeros(len(head), np.int64),
                                 np.arange(len(breaks)) - head[of] + 1])
        starts = np.concatenate([offsets[:-1], breaks + 1])
        after = np.append(breaks, len(self.code))
        ends = np.minimum(np.concatenate([after[head], after[1:]]), offsets[1:][row])
        word = ALNUM_SPLIT[np.minimum(self.code, 255)]
        words = np.append(0, np.cumsum(word, dtype=np.int32))
        keep = np.flatnonzero((ends - starts >= rule.least)
                              | (words[np.maximum(ends, starts)] > words[starts]))
        keep = keep[np.argsort(starts[keep], kind="stable")]
        self.row, self.number, self.starts, self.ends = row[keep], number[keep], starts[keep], ends[keep]
        self.bytes = list(zip(first[self.starts].tolist(), first[self.ends].tolist()))
        self.names = [xxhash.xxh3_128_digest(self.raw[a:b]) for a, b in self.bytes]

    def first(self) -> np.ndarray:
        """Which lines are the first of their name in the slice."""
        place = {name: i for i, name in zip(range(len(self.names) - 1, -1, -1), reversed(self.names))}
        return np.sort(np.fromiter(place.values(), np.int64, len(place)))

    def low(self) -> np.ndarray:
        """The second eight bytes of each name."""
        both = np.frombuffer(b"".join(self.names), ">u8").astype(np.uint64)
        return both[1::2]


def line_rows(docs: DataFrame, id_col: str, text_col: str, rule: Rule) -> DataFrame:
    """(id, h, line, node, low, n, keys) of all compared lines; the keys once per slice and line."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        hasher = RangeHash()
        for batch in batches:
            for part in slices(batch, "_text"):
                lines = Lines(part.column(2), rule)
                size, some = lines.ends - lines.starts, pa.array(lines.row)
                first = lines.first()
                first = first[size[first] >= rule.least]
                keys, counts = line_keys(lines.code, lines.starts[first], lines.ends[first], rule, hasher)
                has, per = np.zeros(len(size), bool), np.zeros(len(size) + 1, np.int64)
                has[first], per[first + 1] = True, counts
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(per).astype(np.int32)),
                                                 pa.array(signed(keys)), mask=pa.array(~has))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(some), part.column(1).take(some),
                     pa.array(lines.number.astype(np.int32)), pa.array(lines.names, pa.binary()),
                     pa.array(signed(lines.low())), pa.array(size.astype(np.int32)), lists],
                    names=["id", "h", "line", "node", "low", "n", "keys"])

    return docs.select(F.col(id_col).alias("_id"), text_hash(text_col).alias("_h"),
                       F.col(text_col).alias("_text")).mapInArrow(
        run, f"id {id_type}, h long, line int, node binary, low long, n int, keys array<long>")


def bucket_rows(lines: DataFrame, rule: Rule) -> DataFrame:
    """(bucket, node, size, full, level): keys that a line is indexed under and another one has.

    Keys travel with half a name and one number; whole names come back for those that met. The join
    is a merge at every size, as at scale neither side is small.
    """
    keyed = lines.filter("keys is not null")
    tau = F.when(F.col("n") < rule.long, 1).otherwise(2)
    rows = keyed.select("low", "n", F.posexplode("keys").alias("i", "k")) \
        .select("k", "low", (2 * F.col("n") + (F.col("i") <= tau).cast("int")).alias("tag"))
    met = rows.groupBy("k").agg(F.min("low").alias("lo"), F.max("low").alias("hi"),
                                F.max(F.col("tag") % 2).alias("full")) \
        .filter("full = 1 and lo <> hi").select("k")
    met = rows.join(materialize(met, "keys").hint("merge"), "k", "left_semi") \
        .groupBy("k", "low").agg(F.max("tag").alias("tag"))
    return materialize(met, "met").join(keyed.select("low", "node").distinct(), "low") \
        .select(F.col("k").alias("bucket"), "node", F.floor(F.col("tag") / 2).cast("int").alias("size"),
                (F.col("tag") % 2 == 1).alias("full"), F.lit(2).alias("level"))


def gram_rows(texts: DataFrame) -> DataFrame:
    """(node, grams): the different runs of ``GRAM`` letters of every line."""
    def run(batches):
        hasher = RangeHash()
        for batch in batches:
            for part in slices(batch, "text", BLOCK):
                data, offsets = text_bytes(part.column(1))
                code = _code_points(data)
                if len(code) != len(data):
                    offsets = np.append(0, np.cumsum((data & 0xC0) != 0x80))[offsets]
                start = np.arange(max(0, len(code) - GRAM + 1))
                of = owner(start, offsets)
                start, of = start[start + GRAM <= offsets[of + 1]], of[start + GRAM <= offsets[of + 1]]
                gram = hasher(code, start, start + GRAM)
                order = np.lexsort((gram, of))
                gram, of = gram[order], of[order]
                new = np.ones(len(gram), bool)
                new[1:] = (gram[1:] != gram[:-1]) | (of[1:] != of[:-1])
                ends = np.append(0, np.cumsum(np.bincount(of[new], minlength=part.num_rows)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)),
                                                              pa.array(signed(gram[new])))],
                    names=["node", "grams"])

    return texts.select("node", "text").mapInArrow(run, "node binary, grams array<long>")


def line_texts(docs: DataFrame, text_col: str, rule: Rule, sources, wanted) -> DataFrame:
    """(node, text) of the lines whose document and name may be wanted."""
    def run(batches):
        source, want = Bitmap(sources), Bitmap(wanted)
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for part in slices(batch.filter(pa.array(source(h))), "_text"):
                lines = Lines(part.column(1), rule)
                keep = np.flatnonzero(want(lines.low()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lines.names[i] for i in keep], pa.binary()),
                     pa.array([lines.raw[slice(*lines.bytes[i])] for i in keep], pa.binary())
                     .cast(pa.string())], names=["node", "text"])

    return docs.select(text_hash(text_col).alias("_h"), F.col(text_col).alias("_text")).mapInArrow(
        run, "node binary, text string")


def within(pairs: list[tuple[str, str]], tau: np.ndarray) -> np.ndarray:
    """Which pairs are at most ``tau`` edits apart: Hyyrö's band of 2 tau + 2 diagonals as bits.

    One machine word per pair holds the band; all pairs of a block take a step together.
    """
    out = np.zeros(len(pairs), bool)
    order = sorted(range(len(pairs)), key=lambda i: max(map(len, pairs[i])))
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi - lo + 1) * max(map(len, pairs[order[hi]])) <= CELLS:
            hi += 1
        block = order[lo:hi]
        out[block] = _block([pairs[i] for i in block], tau[block])
        lo = hi
    return out


def _codes(texts: list[str], before: int, width: int, pad: int) -> np.ndarray:
    out = np.full((len(texts), before + width), pad, np.int32)
    for row, text in enumerate(texts):
        out[row, before:before + len(text)] = np.frombuffer(
            text.encode("utf-32-le", "surrogatepass"), np.int32)
    return out


def _block(pairs: list[tuple[str, str]], tau: np.ndarray) -> np.ndarray:
    most = int(tau.max())
    bits = 2 * most + 2
    one, full = np.uint64(1), np.uint64((1 << bits) - 1)
    long = [max(p, key=len) for p in pairs]
    short = [min(p, key=len) if len(p[0]) != len(p[1]) else p[1] for p in pairs]
    long = [p[0] if len(p[0]) == len(p[1]) else x for p, x in zip(pairs, long)]
    n1, n2 = np.array([len(x) for x in long]), np.array([len(x) for x in short])
    width = int(n1.max())
    # the band's lowest bit looks ``bits - most - 1`` letters before the diagonal
    a = _codes(long, bits, width + bits, -1)
    b = _codes(short, 0, width, -2)
    powers = one << np.arange(bits, dtype=np.uint64)
    vp = np.full(len(pairs), (full << np.uint64(bits - most - 1)) & full)
    vn = np.zeros(len(pairs), np.uint64)
    distance = np.full(len(pairs), most)
    diagonal, horizontal = one << np.uint64(bits - 1), np.full(len(pairs), one << np.uint64(bits - 2))
    start = most + 1 - bits
    for i in range(int(n2.max())):
        lo = start + i + bits
        x = ((a[:, lo:lo + bits] == b[:, i:i + 1]) * powers).sum(1, dtype=np.uint64)
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        live = i < n2
        down = i < n1 - most
        distance += live & down & ((d0 & diagonal) == 0)
        across = live & ~down
        distance += across & ((hp & horizontal) != 0)
        distance -= across & ((hn & horizontal) != 0)
        horizontal = np.where(across, horizontal >> one, horizontal)
        vp = (hn | ~((d0 >> one) | hp)) & full
        vn = (d0 >> one) & hp
    return distance <= tau


def letter_counts(column: pa.Array) -> np.ndarray:
    """How often each text has the letters of each of ``BINS`` classes."""
    out = np.zeros((len(column), BINS), np.int32)
    texts = pa.RecordBatch.from_arrays([pa.array(np.arange(len(column))), column], names=["i", "t"])
    for part in slices(texts, "t", BLOCK):
        data, offsets = text_bytes(part.column(1))
        code, row = _code_points(data), np.repeat(np.arange(part.num_rows), np.diff(offsets))
        if len(code) != len(data):
            row = row[(data & 0xC0) != 0x80]
        first = part.column(0)[0].as_py()
        out[first:first + part.num_rows] = np.bincount(
            row * BINS + (code & (BINS - 1)), minlength=part.num_rows * BINS).reshape(-1, BINS)
    return out


def linked(pairs: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b, ta, tb) whose lines are within the edits of the shorter one."""
    def run(batches):
        for batch in batches:
            one, two = letter_counts(batch.column(2)), letter_counts(batch.column(3))
            sizes = one.sum(1), two.sum(1)
            tau = np.array([rule.tau(int(n)) for n in np.minimum(*sizes)], int)
            # an edit changes the lengths by one at most, and takes a letter or brings one or both
            near = (np.abs(sizes[0] - sizes[1]) <= tau) & (np.abs(one - two).sum(1) <= 2 * tau)
            some = batch.filter(pa.array(near))
            texts = list(zip(some.column(2).to_pylist(), some.column(3).to_pylist()))
            near[near] = within(texts, tau[near])
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).filter(pa.array(near)) for i in (0, 1)], names=["a", "b"])

    return pairs.select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary")


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = Rule(),
             bits: int = BITS) -> DataFrame:
    """(id, h, n_lines, removed): per document its compared lines and the numbers of those to go."""
    lines = materialize(line_rows(docs, id_col, text_col, rule), "lines")
    rows = materialize(bucket_rows(lines, rule), "candidates")
    release(docs.sparkSession)
    # a line's text is taken from one of its documents
    origin = materialize(lines.join(rows.select("node").distinct(), "node", "left_semi")
                         .groupBy("node", "low").agg(F.min("h").alias("h")), "origins")
    texts = line_texts(docs, text_col, rule, build(origin, "h", bits), build(origin, "low", bits))
    texts = materialize(texts.groupBy("node").agg(F.any_value("text").alias("text")), "texts")

    def test(pairs: DataFrame) -> DataFrame:
        both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")
        return linked(both, rule)

    grams = materialize(gram_rows(texts), "grams")

    def differ(one, two):       # an edit takes at most four grams and brings at most four
        return 2 * GRAM * F.when(F.least(one, two) < rule.long, 1).otherwise(2)

    def sizes(large, small):
        return large - small <= 2

    labels = cluster(rows, test, sizes,
                     narrow=lambda members: near_pairs(members, grams, differ, sizes, False))
    place = F.struct(F.col("id").cast("string").isNotNull().alias("known"), "id", "h", "line")
    nodes = lines.groupBy("node").agg(F.min(place).alias("first"), F.count("line").alias("times"))
    nodes = nodes.join(labels, "node", "left").filter("times > 1 or comp is not null")
    nodes = materialize(nodes.withColumn("comp", F.coalesce("comp", "node")), "nodes")
    first = materialize(nodes.groupBy("comp").agg(F.min("first").alias("first")), "firsts")
    keep = materialize(nodes.select("node", "comp").join(first, "comp").select("node", "first"),
                       "keep")
    gone = F.col("first").isNotNull() & (place != F.col("first"))
    return lines.select("id", "h", "line", "node").distinct().join(keep, "node", "left") \
        .groupBy("id", "h").agg(
            F.count("line").alias("n_lines"),
            F.sort_array(F.collect_list(F.when(gone, F.col("line")))).alias("removed"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           rule: Rule = Rule()) -> DataFrame:
    """One row per document: id, compared lines, removed lines and their numbers."""
    found = materialize(removals(docs, id_col, text_col, rule), "removals")
    base = docs.select(F.col(id_col).alias("id"), text_hash(text_col).alias("h"))
    return on_document(base, found, "left").select(
        F.col("id").alias(id_col), F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               rule: Rule = Rule()) -> DataFrame:
    """The documents without the lines that repeat an earlier one; all columns pass on.

    A document that keeps nothing but blanks after losing lines goes.
    """
    names = docs.columns
    found = materialize(removals(docs, id_col, text_col, rule).filter(F.size("removed") > 0),
                        "removals")
    text = F.col(f"d.`{text_col}`")
    left = F.array_join(F.filter(F.split(text, "\n", -1),
                                 lambda x, i: ~F.array_contains("removed", i)), "\n")
    rest = on_document(packed(docs, id_col, text_col), found, "left").select(
        "d", "removed", F.when(F.col("removed").isNull(), text).otherwise(left).alias("left"))
    return rest.filter(F.col("removed").isNull() | (F.trim(F.regexp_replace("left", r"\s", "")) != "")) \
        .select(*[(F.col("left") if c == text_col else F.col(f"d.`{c}`")).alias(c) for c in names])
