"""Exact substring deduplication by bucket-pointer refinement of suffixes.

Suffixes are put into buckets by their first q bytes; a bucket's identifier is then enough to stand for those bytes, and
buckets for twice as many bytes come from pairs of identifiers, one of them at a later offset. So each doubling reuses
what the one before has found, and suffixes that are alone in their bucket leave early. Identifiers are 64-bit
fingerprints, which tasks find for themselves: q = 1, 2, 4, ... within a document's own bytes, without a shuffle.

What is shuffled are few suffixes. Each string of `length` bytes contains w = length - q + 1 suffix starts whose q-gram
buckets it can see, and the least identifier of those is the same wherever the string stands. Consecutive strings that
see the least identifier, and see it first at the same place, make a segment, on average w / 2 strings long. Then

1. segments are dealt by that q-gram bucket; a bucket with one segment holds no repeated string and is dropped;
2. within a bucket, segments with equal bytes (equal identifiers at all later offsets) form a class. If a bucket is one
   class, all strings of its segments are repeated;
3. only in buckets with several classes, one segment of each class is refined, with a q close to the length: identifiers
   of that depth come from pairs of those at hand, and steps 1 and 2 are repeated for its far shorter segments;
4. what is still mixed is refined to its single strings, named by the pair of identifiers at their start and at the
   offset that reaches their end. A string that occurs twice is repeated.

A hot bucket is never gathered: classes and strings are counted with partial sums, and joins may split a hot key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import GOLD, chunks, drop, mix, own_columns, remembered, slices, spans, squeezed, stash, unsqueezed

_BYTE_IDS = mix(np.arange(1, 257, dtype=np.uint64) * GOLD)
_K = np.uint64(0xD6E8FEB86659FD93)
#: Bytes whose identifiers a task holds at once.
CHUNK = 1 << 19


def refine(ids: np.ndarray, offset: int) -> np.ndarray:
    """Identifiers of twice the depth: of the bucket at each place and the bucket `offset` later."""
    out = ids[:-offset] * GOLD
    out += ids[offset:]
    out ^= out >> np.uint64(32)
    out *= _K
    return out


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix((a ^ (a >> np.uint64(29))) * GOLD + b)


def deep_q(length: int) -> int:
    """The second q: close to the length, and at least the deepest power of two in it."""
    return max(1 << (length.bit_length() - 1), length - max(1, length // 25))


class Buckets:
    """Bucket identifiers of all places of some bytes: of q-grams, and of the deepest power of two in `length`."""

    def __init__(self, data: bytes, length: int):
        self.length = length
        self.top = 1 << (length.bit_length() - 1)
        self.q = max(1, self.top // 2)
        self.deep_q = deep_q(length)
        ids = _BYTE_IDS[np.frombuffer(data, dtype=np.uint8)]
        depth, self.grams = 1, ids
        while depth < self.top:
            ids = refine(ids, depth) if len(ids) > depth else ids[:0]
            depth *= 2
            if depth == self.q:
                self.grams = ids
        self.deep = ids

    def strings(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The names of the strings of `length` bytes that start at these places."""
        return self.deep[at], self.deep[at + (self.length - self.top)]

    def least(self, deep: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """For each string, the least identifier of its q-grams, and whether the string's start has it."""
        q = self.deep_q if deep else self.q
        w = self.length - q + 1
        if deep:
            x = pair(self.deep[: len(self.deep) - (q - self.top)], self.deep[q - self.top :])
        else:
            x = mix(self.grams.copy())
        n = len(x) - w + 1
        if n <= 0:
            return x[:0], np.zeros(0, bool)
        full = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
        full[: len(x)] = x
        rows = full.reshape(-1, w)
        before = np.minimum.accumulate(rows, axis=1).reshape(-1)
        after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        out = np.minimum(after[:n], before[w - 1 : w - 1 + n])
        return out, out == x[:n]

    def equal(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """A name for the bytes that strings lo .. hi cover: identifiers at every `top`-th offset and at the end."""
        size = hi - lo + self.length
        out = pair(size.astype(np.uint64), self.deep[lo + size - self.top])
        step, left = 0, np.arange(len(lo))
        while len(left):
            out[left] = pair(out[left], self.deep[lo[left] + step])
            step += self.top
            left = left[size[left] - self.top > step]
        return out


def segments(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(document, lo, hi, gram, equal): strings lo .. hi of a document have their least q-gram at one place."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts, n = np.cumsum(sizes) - sizes, np.maximum(sizes - length + 1, 0)
    use = np.flatnonzero(n)
    if not len(use):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    b = Buckets(b"".join(texts), length)
    least, first = b.least()
    cut = np.empty(len(least) + 1, dtype=bool)
    cut[0] = cut[-1] = True
    np.not_equal(least[1:], least[:-1], out=cut[1:-1])
    cut[1:-1] |= first[:-1]  # the next string sees another place of that q-gram, if it has one at all
    inside = np.zeros(len(least) + 2, dtype=np.int8)
    inside[starts[use]] = 1
    np.add.at(inside, starts[use] + n[use], -1)
    cut[starts[use]] = True
    cut[np.minimum(starts[use] + n[use], len(least))] = True
    alive = np.cumsum(inside[: len(least)], dtype=np.int8).astype(bool)
    edges = np.flatnonzero(cut)
    lo, hi = edges[:-1], edges[1:] - 1
    keep = alive[lo]
    lo, hi = lo[keep], hi[keep]
    doc = np.searchsorted(starts, lo, side="right") - 1
    while len(bad := np.flatnonzero(sizes[doc] == 0)):  # empty documents share a start with the next
        doc[bad] += 1
    return doc, lo - starts[doc], hi - starts[doc], least[lo], b.equal(lo, hi)


def _segments(held: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered(None)
        for b in chain.from_iterable(map(slices, batches)):
            for ids, texts in chunks(b.column("row").to_pylist(), unsqueezed(b.column("z")), CHUNK):
                doc, lo, hi, gram, equal = segments(texts, length)
                yield _segment_rows(np.array(ids)[doc], lo, hi, gram, equal, np.ones(len(doc)))

    return held.select("row", "z").mapInArrow(run, SEGMENTS)


SEGMENTS = "row long, lo int, hi int, gram long, equal long, members int"


def _segment_rows(row: np.ndarray, lo: np.ndarray, hi: np.ndarray, gram: np.ndarray, equal: np.ndarray, members: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(row.astype(np.int64)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(gram.view(np.int64)), pa.array(equal.view(np.int64)), pa.array(members.astype(np.int32))], names=["row", "lo", "hi", "gram", "equal", "members"])


def _finer(held: DataFrame, refined: DataFrame, length: int) -> DataFrame:
    """Segments by the second q of the segments to be refined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, data, parts in zip(b.column("row").to_pylist(), unsqueezed(b.column("z")), b.column("parts").to_pylist(), strict=True):
                ids = Buckets(data, length)
                least, first = ids.least(deep=True)
                start, n = np.array([p["lo"] for p in parts]), np.array([p["hi"] - p["lo"] + 1 for p in parts])
                step = spans(n)
                at = np.repeat(start, n) + step
                before = np.maximum(at - 1, 0)
                heads = np.flatnonzero((step == 0) | (least[at] != least[before]) | first[before])
                lo, hi = at[heads], at[np.append(heads[1:], len(at)) - 1]
                members = np.minimum([p["members"] for p in parts], 2)
                yield _segment_rows(np.full(len(lo), row), lo, hi, least[lo], ids.equal(lo, hi), np.repeat(members, n)[heads])

    return held.select("row", "z").join(_per_row(refined), "row").select("row", "z", "parts").mapInArrow(run, SEGMENTS)


def _per_row(refined: DataFrame) -> DataFrame:
    return refined.groupBy("row").agg(F.collect_list(F.struct("lo", "hi", "members")).alias("parts"))  # of one document


def settle(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(whole, to refine): segments all of whose strings are repeated, and those to be taken apart; both written down, and
    all tables on the way there deleted.

    A segment stands for `members` with equal bytes. Each class in a bucket with several is to be refined, once.
    """
    # What is written down first reaches a join by an exchange alone, so that a hot bucket's rows can be split there.
    shared = stash(own.groupBy("gram").agg(F.sum("members").alias("n")).where("n > 1").select("gram"), "shared")
    met = stash(own.join(shared, "gram"), "segments")
    drop(shared)
    one = F.struct("row", "lo", "hi")
    several = stash(met.groupBy("gram", "equal").agg(F.sum("members").alias("members"), F.min(one).alias("first")), "classes")
    mixed = stash(several.groupBy("gram").agg(F.count("*").alias("classes")).where("classes > 1").select("gram"), "mixed")
    refined = stash(several.join(mixed, "gram", "left_semi").select("first.row", "first.lo", "first.hi", "members"), "refine")
    whole = stash(met.where("members = 1").join(several.where("members > 1").select("gram", "equal"), ["gram", "equal"], "left_semi").select("row", "lo", "hi"), "whole")
    drop(met, several, mixed)
    return whole, refined


def _strings(held: DataFrame, refined: DataFrame, length: int) -> DataFrame:
    """(a, b, row, at, members): the strings of the segments to be refined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, data, parts in zip(b.column("row").to_pylist(), unsqueezed(b.column("z")), b.column("parts").to_pylist(), strict=True):
                ids = Buckets(data, length)
                lo, n = np.array([p["lo"] for p in parts]), np.array([p["hi"] - p["lo"] + 1 for p in parts])
                at = np.repeat(lo, n) + spans(n)
                x, y = ids.strings(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mix(x.copy()).view(np.int64)), pa.array(y.view(np.int64)), pa.array(np.full(len(at), row)), pa.array(at.astype(np.int32)), pa.array(np.repeat(np.minimum([p["members"] for p in parts], 2).astype(np.int32), n))],
                    names=["a", "b", "row", "at", "members"],
                )

    return held.select("row", "z").join(_per_row(refined), "row").select("row", "z", "parts").mapInArrow(run, "a long, b long, row long, at int, members int")


RESULT = "row long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:int,end:int>>"


def remove_repeats(docs: DataFrame, length: int = 200, kept: str | None = "binary") -> DataFrame:
    """Per row of docs (doc_id, text): n_bytes, n_removed, n_spans, kept_sha256, removed, and kept.

    Removed is each byte of the UTF-8 text that is covered by a string of `length` bytes which also starts anywhere else, in
    this row or another; all occurrences go. Matches don't cross rows. A null text counts as empty. Rows that share a
    doc_id, or have none, are documents of their own. Other columns aren't read; an empty table gives no rows.

    kept is the type in which what remains is returned: binary, or string without characters of which a cut leaves only
    some bytes; None leaves the column out.
    """
    held = stash(squeezed(own_columns(docs, "doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "row"), "texts")
    return without_repeats(held, length, kept).drop("row")


def without_repeats(held: DataFrame, length: int, kept: str | None) -> DataFrame:
    whole, mixed = settle(_segments(held, length))
    parts = stash(_finer(held, mixed, length), "finer")
    drop(mixed)
    finer, mixed = settle(parts)
    drop(parts)
    strings = stash(_strings(held, mixed, length), "strings")
    drop(mixed)
    twice = stash(strings.groupBy("a", "b").agg(F.sum("members").alias("n")).where("n > 1").select("a", "b"), "twice")
    found = strings.where("members = 1").join(twice, ["a", "b"], "left_semi").select("row", F.col("at").alias("lo"), F.col("at").alias("hi"))
    per_row = whole.unionByName(finer).unionByName(found).groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("parts"))  # of one document

    last = {"binary": pa.binary(), "string": pa.string()}.get(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered(None)
        for b in chain.from_iterable(map(slices, batches)):
            out = []
            for row, doc_id, z, parts in zip(*(b.column(c).to_pylist() for c in ("row", "doc_id", "z", "parts")), strict=True):
                data, gone = zstandard.decompress(z) if z is not None else b"", []
                left = data
                if parts:
                    edge = np.zeros(len(data) + 1, dtype=np.int64)
                    np.add.at(edge, [p["lo"] for p in parts], 1)
                    np.add.at(edge, [p["hi"] + length for p in parts], -1)
                    covered = np.cumsum(edge)[:-1] > 0
                    turns = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0))
                    gone = list(zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True))
                    left = np.frombuffer(data, dtype=np.uint8)[~covered].tobytes()
                out.append((row, doc_id, len(data), len(data) - len(left), len(gone), hashlib.sha256(left).hexdigest(), [{"start": s, "end": e} for s, e in gone], left.decode("utf-8", "ignore") if kept == "string" else left))
            types = [pa.int64()] * 5 + [pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), *([last] if kept else [])]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["row", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept"][: len(types)])

    return held.join(per_row, "row", "left").select("row", "doc_id", "z", "parts").mapInArrow(run, RESULT + (f", kept {kept}" if kept else ""))
