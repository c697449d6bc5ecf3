"""SentencePiece encoding and decoding (8): suffix-array matching.

Per batch the distinct words are put into one text and its suffixes sorted, to the depth of the
longest piece. A binary search over the suffixes gives every piece its range of occurrences; the
ranges are the edges (start, end, piece), which are sorted by position and relaxed from left to
right. The model at hand merges pairs (BPE), where the best sum of scores would give other ids; so
an edge relaxes if its piece is stable behind the piece that ends at its start, that is if merging
the two pieces' letters gives just these two. A chain of stable pairs is the encoding, and exactly
one edge relaxes into every position.

Words are cut where no piece can cross: before a blank that follows something else, and around
characters that no piece holds, which become byte pieces (or the unknown id).

Edge cases: a null or empty text has no ids and decodes to an empty text. Texts of any length are
one row; a word of any length is relaxed in one pass. U+2581 in a text decodes to a blank and bytes
that are no UTF-8 to U+FFFD, as in the format. Empty tables give no rows; equal texts get equal
ids. Other columns pass on unread; the new column's name must be free.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .arrays import slices

BLANK = "▁"
SLICE = 8 << 20
MATCHED = 300_000         # letters of one suffix array
PACKED = 4                # letters that are compared as one number
CACHED_WORDS = 200_000
CACHED_PAIRS = 1_000_000
NORMAL, UNKNOWN, BYTE = 1, 2, 6       # piece types of the model format that matter here


def _fields(data: bytes):
    """(number, value) of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at:at + size]
            at += size


@dataclass(frozen=True)
class Model:
    """Pieces of a BPE model file with an identity normaliser."""
    pieces: tuple
    scores: tuple
    kinds: tuple
    prefix: bool

    @classmethod
    def read(cls, path: str) -> "Model":
        with open(path, "rb") as f:
            data = f.read()
        pieces, scores, kinds, prefix, squeeze, kind, rules = [], [], [], True, True, 1, b""
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                kind = dict(_fields(value)).get(3, 1)
            elif number == 3:
                spec = dict(_fields(value))
                rules, prefix = spec.get(2, b""), bool(spec.get(3, 1))
                squeeze = bool(spec.get(4, 1))
        if kind != 2 or rules or squeeze:
            raise ValueError("only BPE models that leave texts as they are can be used")
        letters = {c for p, k in zip(pieces, kinds) if k == NORMAL for c in p}
        if not letters <= {p for p, k in zip(pieces, kinds) if k == NORMAL}:
            raise ValueError("a piece holds a letter that is no piece")
        return cls(tuple(pieces), tuple(scores), tuple(kinds), prefix)


class Encoder:
    """One task's view of the model, with bounded caches of words and of piece pairs."""

    def __init__(self, model: Model):
        self.model = model
        normal = [i for i, k in enumerate(model.kinds) if k == NORMAL]
        self.id_of = {model.pieces[i]: i for i in normal}
        self.score = {model.pieces[i]: model.scores[i] for i in normal}
        letters = "".join(sorted({c for p in self.id_of for c in p} - {BLANK}))
        known = "[" + re.escape(letters) + "]"
        crossing = any(BLANK in p.lstrip(BLANK) for p in self.id_of)
        self.units = re.compile(f"(?:{known}|{BLANK})+|." if crossing
                                else f"{BLANK}+{known}*|{known}+|.", re.S)
        self.bytes_of = {int(p[3:5], 16): i for i, (p, k) in
                         enumerate(zip(model.pieces, model.kinds)) if k == BYTE}
        self.unknown = model.kinds.index(UNKNOWN)
        # a piece that its own letters do not merge into never comes out
        usable = [p for p in self.id_of if len(self._merged(p)) == 1]
        self.usable = sorted(usable, key=lambda p: (len(p), p))
        self.usable_ids = np.array([self.id_of[p] for p in self.usable], np.int64)
        self.longest = max(map(len, self.usable))
        # letters of all pieces, a row each, as places in ``alphabet``; behind a piece's end stands NUL
        width = -(-self.longest // PACKED) * PACKED
        self.lengths = np.array([len(p) for p in self.usable], np.int64)
        points = np.frombuffer("".join(p.ljust(width, "\0") for p in self.usable)
                               .encode("utf-32-le", "surrogatepass"), np.int32)
        self.alphabet, rows = np.unique(points, return_inverse=True)
        self.rows = rows.reshape(len(self.usable), width).astype(np.int32)
        self._forget_pairs()
        self._clear()

    def _clear(self):
        self.words: dict[str, int] = {}
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    # -- pairs ---------------------------------------------------------------------------

    def _merged(self, text: str, border: int = -1) -> list[str] | None:
        """Letters merged by score, leftmost first; None once a merge crosses ``border``."""
        parts, score = list(text), self.score
        ends = list(range(1, len(parts) + 1))
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            if ends[at] == border:
                return None
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del ends[at]
        return parts

    def _stable(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Whether each pair of ids keeps its border; ``before`` is -1 at the start of a word."""
        size = len(self.model.pieces)
        pairs, back = np.unique((before + 1) * size + after, return_inverse=True)
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        out = self.keeps[at]
        new = np.flatnonzero((self.pairs[at] != pairs) & (pairs >= size))
        if len(new):
            found = []
            for key in pairs[new].tolist():
                one, two = (self.model.pieces[x] for x in (key // size - 1, key % size))
                found.append(self._merged(one + two, len(one)) is not None)
            out[new] = found
            if len(self.pairs) > CACHED_PAIRS:
                self._forget_pairs()
            where = np.searchsorted(self.pairs, pairs[new])
            self.pairs = np.insert(self.pairs, where, pairs[new])
            self.keeps = np.insert(self.keeps, where, found)
        out[pairs < size] = True
        return out[back]

    def _forget_pairs(self):
        self.pairs, self.keeps = np.full(1, -1), np.ones(1, bool)

    # -- suffix array --------------------------------------------------------------------

    def _suffixes(self, codes: np.ndarray) -> np.ndarray:
        """Suffixes of the batch text in order of their first ``longest`` letters."""
        n, depth = len(codes), 4 if codes.max() < 1 << 15 else 1
        key = np.zeros(n, np.int64)
        for j in range(depth):                             # the first letters at once
            key[:n - j] |= codes[j:] << 15 * (depth - 1 - j)
        while True:
            order = np.argsort(key)
            if depth >= self.longest:
                return order
            new = np.ones(n, np.int64)
            ordered = key[order]
            new[1:] = ordered[1:] != ordered[:-1]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
            key = rank * (n + 1)
            key[:n - depth] += rank[depth:]
            depth *= 2

    def _ranges(self, codes: np.ndarray, suffixes: np.ndarray, pieces: np.ndarray,
                lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 suffix that starts with each piece: one search for all pieces.

        ``pieces`` ascend by length. Letters are compared ``PACKED`` at a time, or one by one in a
        text of very many different ones.
        """
        step = PACKED if codes.max() < 1 << 15 else 1
        width = pieces.shape[1]
        shifts = [15 * (step - 1 - j) for j in range(step)] if step > 1 else [0]
        padded = np.concatenate([codes, np.zeros(width + step, codes.dtype)])
        packed = sum(padded[j:len(codes) + width + j] << s for j, s in enumerate(shifts))
        letter = (1 << 15) - 1 if step > 1 else -1
        parts = []                          # (offset, first piece that reaches it, value, mask)
        for at in range(0, width, step):
            begin = int(np.searchsorted(lengths, at, "right"))
            rows = pieces[begin:, at:at + step]
            value = sum(rows[:, j] << s for j, s in enumerate(shifts))
            mask = sum(np.where(lengths[begin:] > at + j, letter, 0) << s
                       for j, s in enumerate(shifts))
            parts.append((at, begin, value, mask))
        found = []
        for past in (False, True):
            lo = np.zeros(len(pieces), np.int64)
            hi = np.full(len(pieces), len(suffixes))
            while (live := lo < hi).any():
                mid = (lo + hi) // 2
                at = suffixes[np.minimum(mid, len(suffixes) - 1)]
                sign = np.zeros(len(pieces), np.int8)
                for offset, begin, value, mask in parts:
                    rest = sign[begin:]
                    even = np.flatnonzero(rest == 0)
                    if not len(even):
                        continue
                    text = packed[at[begin:][even] + offset] & mask[even]
                    rest[even] = np.sign(text - value[even])
                right = live & ((sign < 0) | (past & (sign == 0)))
                lo = np.where(right, mid + 1, lo)
                hi = np.where(live & ~right, mid, hi)
            found.append(lo)
        return found[0], found[1]

    def _match(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and the number of each word's ids."""
        text = "\0".join(words) + "\0"
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.int32)
        alphabet, codes = np.unique(points, return_inverse=True)
        codes = codes.astype(np.int64)                     # the separator is the smallest: 0
        suffixes = self._suffixes(codes)
        place = np.minimum(np.searchsorted(alphabet, self.alphabet), len(alphabet) - 1)
        rows = np.where(alphabet[place] == self.alphabet, place, -1)[self.rows]
        present = np.flatnonzero((rows >= 0).all(1))
        pieces, lengths = rows[present], self.lengths[present]
        lo, hi = self._ranges(codes, suffixes, pieces, lengths)
        count = hi - lo
        which = np.repeat(np.arange(len(present)), count)
        start = suffixes[np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        piece, end = self.usable_ids[present][which], start + lengths[which]
        ends = np.flatnonzero(codes == 0)
        starts = np.concatenate([[0], ends[:-1] + 1])
        place = np.arange(len(codes)) - np.repeat(starts, ends + 1 - starts)
        offset = place[start]
        top = int(offset.max())
        order = np.argsort(offset.astype(np.uint16) if top < 1 << 16 else offset, kind="stable")
        start, end, piece = start[order], end[order], piece[order]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(offset, minlength=top + 1))])
        last = np.full(len(codes) + 1, -2, np.int64)       # the piece that ends here
        back = np.zeros(len(codes) + 1, np.int64)
        last[starts] = -1
        for a, b in zip(bounds[:-1], bounds[1:]):          # same place in all words at once
            s, e, p = start[a:b], end[a:b], piece[a:b]
            before = last[s]
            ok = before > -2
            ok[ok] = self._stable(before[ok], p[ok])
            last[e[ok]], back[e[ok]] = p[ok], s[ok]
        used = np.zeros(len(codes) + 1, bool)
        at, first = ends.copy(), starts
        while len(at):
            used[at] = True
            at = back[at]
            more = at > first
            at, first = at[more], first[more]
        where = np.flatnonzero(used)
        return last[where].astype(np.int32), np.bincount(
            np.searchsorted(ends, where, "left"), minlength=len(words))

    # -- texts ---------------------------------------------------------------------------

    def _learn(self, words: list[str]) -> None:
        plain = [w for w in words if w[0] in self.id_of]
        odd = [w for w in words if w[0] not in self.id_of]
        ids, counts = np.zeros(0, np.int32), np.zeros(0, np.int64)
        ends = np.cumsum([len(w) + 1 for w in plain])
        lo = 0
        while lo < len(plain):             # the edges of a text are several times its letters
            before = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + MATCHED, "right")))
            more = self._match(plain[lo:hi])
            ids, counts = np.concatenate([ids, more[0]]), np.concatenate([counts, more[1]])
            lo = hi
        for w in odd:
            raw = [self.bytes_of.get(b, self.unknown) for b in w.encode("utf-8", "replace")] \
                if self.bytes_of else [self.unknown]
            ids, counts = np.append(ids, np.array(raw, np.int32)), np.append(counts, len(raw))
        for w in plain + odd:
            self.words[w] = len(self.words)
        self.ids = np.concatenate([self.ids, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts)])

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        if len(self.words) > CACHED_WORDS:
            self._clear()
        units = [self.units.findall((BLANK if self.model.prefix else "") + t.replace(" ", BLANK))
                 if t else [] for t in texts]
        flat = list(chain.from_iterable(units))
        if new := set(flat).difference(self.words):
            self._learn(sorted(new))
        index = np.fromiter(map(self.words.__getitem__, flat), np.int64, len(flat))
        sizes = np.diff(self.ends)[index]
        ids = self.ids[np.repeat(self.ends[index] - (np.cumsum(sizes) - sizes), sizes)
                       + np.arange(sizes.sum())]
        per = np.concatenate([[0], np.cumsum([len(r) for r in units])]).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])[per].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))


class Decoder:
    """Ids to texts by table look-up of the pieces' bytes."""

    def __init__(self, model: Model):
        raw = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(BLANK, " ").encode()
               if k == NORMAL else " ⁇ ".encode() if k == UNKNOWN else b""
               for p, k in zip(model.pieces, model.kinds)]
        self.table = np.frombuffer(b"".join(raw), np.uint8)
        self.ends = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        self.prefix = model.prefix

    def decode(self, ids: pa.ListArray) -> list[str]:
        flat = np.asarray(ids.flatten(), np.int64)
        sizes = np.diff(self.ends)[flat]
        data = self.table[np.repeat(self.ends[flat] - (np.cumsum(sizes) - sizes), sizes)
                          + np.arange(sizes.sum())].tobytes()
        lengths = np.array([0 if n is None else n for n in ids.value_lengths().to_pylist()], np.int64)
        at = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(lengths)])]
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])]
        return [t[1:] if self.prefix and t.startswith(" ") else t for t in texts]


def _appended(df: DataFrame, column: str, kind: T.DataType, run) -> DataFrame:
    if column.lower() in [c.lower() for c in df.columns]:
        raise ValueError(f"column {column} exists")
    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(column, kind)]))


def encode(docs: DataFrame, model: Model, text_col: str = "text", out: str = "ids") -> DataFrame:
    """All columns and the piece ids of ``text_col``."""
    # plain values, as workers need not have this package
    shared, names = docs.sparkSession.sparkContext.broadcast(vars(model)), docs.columns

    def run(batches):
        encoder = Encoder(Model(**shared.value))
        for batch in batches:
            for part in slices(batch, text_col, SLICE):
                ids = encoder.encode(part.column(names.index(text_col)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*names, out])

    return _appended(docs, out, T.ArrayType(T.IntegerType()), run)


def decode(df: DataFrame, model: Model, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns and the text of ``ids_col``."""
    shared, names = df.sparkSession.sparkContext.broadcast(vars(model)), df.columns

    def run(batches):
        decoder = Decoder(Model(**shared.value))
        for batch in batches:
            texts = decoder.decode(batch.column(names.index(ids_col)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())],
                                             names=[*names, out])

    return _appended(df, out, T.StringType(), run)
