"""A bigram language model in a log-frequency Bloom filter.

Words and pairs of neighbouring words are counted over all training texts. All pairs go into the filter: a pair of count 1
has level 1, one of count c level 2 + log_BASE(c / 2), rounded down, and is entered once for each level from 1 to its own. A
pair's count is read back by probing level after level until one is absent; the last one present gives the count, rounded
down. An absent pair has no level but by a false positive, of which RATE says how likely it is.

P(w | h) mixes the pair's share of h's count with the add-one probability of w alone; the mixture's weight depends on how
often h occurs, and is estimated on all training texts with each pair's own occurrence left out.

Texts are kept in blocks of about BLOCK_BYTES. The HOT most frequent words are broadcast with their counts. A block asks for
those of its other distinct words once: questions are dealt to shards by a hash of the word and stream past the shard's
counts, and answers go back to the block. Shards and blocks don't grow with the corpus, only their number; counts are summed
in tasks first, and then in steps of FAN. The filter has a segment for each shard. Segments are broadcast to the workers
when they have at most FILTER_BYTES together; beyond, a block's pairs are asked for in the same manner as its words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import as_bytes, chunks, crc32_text, drop, mix, own_columns, shuffle_width, stash
from tracewell.llm.shingles import hashes, words

BLOCK_BYTES = 4 << 20
#: Bytes of text for which there is a shard.
SHARD_BYTES = 16 << 20
#: Tokens whose counts a task gathers before it gives them on.
FLUSH = 4_000_000
#: Words that are broadcast, at most; tables of counts that are summed at once.
HOT, FAN = 1 << 18, 64
#: Between levels from the second on; bits and probes for each entry.
BASE, BITS, PROBES = 1.5, 12, 8
RATE = (1 - math.exp(-PROBES / BITS)) ** PROBES
#: Filters up to this size are broadcast.
FILTER_BYTES = 96 << 20
#: The token before the first word and behind the last.
EDGE = np.uint64(0x5851F42D4C957F2D)


def press(x: np.ndarray) -> bytes:
    """Integers as bytes, compressed place by place; ascending ones best as differences."""
    x = np.ascontiguousarray(x)
    return zstandard.compress(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes(), 1)


def unpress(b: bytes, dtype: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(b), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(dtype)


def press_sorted(x: np.ndarray) -> bytes:
    return press(np.diff(x, prepend=np.uint64(0)))


def unpress_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpress(b, np.uint64), dtype=np.uint64)


def press_few(x: np.ndarray) -> tuple[bytes, bytes]:
    """Numbers that repeat: the distinct ones by frequency, and for each its place among them."""
    kinds, at, n = np.unique(x, return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    place = np.empty(len(order), np.uint32)
    place[order] = np.arange(len(order), dtype=np.uint32)
    return press(kinds[order]), press(place[at])


def unpress_few(kinds: bytes, places: bytes) -> np.ndarray:
    return unpress(kinds, np.int64)[unpress(places, np.uint32)]


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts in turn, an EDGE before and behind each, and the number of words of each."""
    split = [words(t) for t in texts]
    n = np.array([len(w) for w in split], dtype=np.int64)
    out = np.full(int(n.sum()) + len(n) + 1, EDGE, dtype=np.uint64)
    inside = np.ones(len(out), bool)
    inside[0] = False
    inside[np.cumsum(n + 1)] = False
    out[inside] = hashes([w for x in split for w in x])
    return out, n


def pairs(t: np.ndarray) -> np.ndarray:
    """A 64-bit name for each token with the one before it."""
    return mix(mix(t[:-1] * np.uint64(0x9E3779B97F4A7C15)) + t[1:])


def summed(x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(x, kind="stable")
    x = x[order]
    heads = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[heads], (np.add.reduceat(counts[order], heads) if len(x) else counts)


def shard_of(x: np.ndarray, shards: int) -> np.ndarray:
    return ((x & np.uint64(0xFFFFFFFF)) * np.uint64(shards)) >> np.uint64(32)


def by_shard(x: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts distinct x by shard and then value, and where shards begin."""
    shard = shard_of(x, shards)
    order = np.lexsort((x, shard))
    return order, np.searchsorted(shard[order], np.arange(shards + 1, dtype=np.uint64))


def levels(counts: np.ndarray) -> np.ndarray:
    return np.where(counts > 1, np.floor(np.log(np.maximum(counts, 2) / 2) / math.log(BASE) + 1e-9).astype(np.int64) + 2, 1)


def count_of(level: np.ndarray) -> np.ndarray:
    return np.where(level > 1, 2 * BASE ** (level - 2.0), np.where(level > 0, 1.0, 0.0))


def _hashes(x: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = mix(x + level.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    return h, (h >> np.uint64(17)) * np.uint64(0xE7037ED1A0B428DB) | np.uint64(1)


def _bit(h: np.ndarray, step: np.ndarray, k: int, size: np.ndarray | np.uint64) -> np.ndarray:
    """The k-th bit of `size` (below 2^32), from the high half of a hash."""
    return (((h + np.uint64(k) * step) >> np.uint64(32)) * size) >> np.uint64(32)


def build_filter(x: np.ndarray, counts: np.ndarray) -> bytes:
    """A filter for names x with counts of 1 or more."""
    top = levels(counts)
    size = max(64, int(top.sum()) * BITS)
    size += -size % 8
    bits = np.zeros(size, dtype=bool)
    for level in range(1, int(top.max(initial=0)) + 1):
        h, step = _hashes(x[top >= level], np.array(level))
        for k in range(PROBES):
            bits[_bit(h, step, k, np.uint64(size))] = True
    return np.packbits(bits, bitorder="little").tobytes()


class Filter:
    """Segments of a filter, one for each shard."""

    def __init__(self, segments: list[bytes]):
        self.sizes = np.array([len(s) * 8 for s in segments], dtype=np.uint64)
        self.bases = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(segments), np.uint8)

    def levels(self, x: np.ndarray) -> np.ndarray:
        """Levels of names (0: absent)."""
        shard = shard_of(x, len(self.sizes))
        size, base = self.sizes[shard], self.bases[shard]
        level, alive = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(alive):
            h, step = _hashes(x[alive], level[alive] + 1)
            own = alive
            for k in range(PROBES):
                at = _bit(h, step, k, size[own]) + base[own]
                there = (self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
                own, h, step = own[there], h[there], step[there]
                if not len(own):
                    break
            alive = own
            level[alive] += 1
        return level


def _blocks(docs: DataFrame) -> DataFrame:
    """(block, doc_ids, held, sizes, z): texts in blocks, numbered by the task's partition and their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, ids, held, texts, size, row = zstandard.ZstdCompressor(level=1), [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            out = {"block": pa.array([row]), "doc_ids": pa.array([ids], pa.list_(pa.int64())), "held": pa.array([held], pa.list_(pa.bool_())), "sizes": pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), "z": pa.array([squeeze.compress(b"".join(texts))], pa.binary())}
            return pa.RecordBatch.from_pydict(out)

        for b in batches:
            for i, h, t, r in zip(b.column("doc_id").to_pylist(), b.column("held_out").to_pylist(), as_bytes(b.column("text")), b.column("row").to_pylist(), strict=True):
                if not texts:
                    row = r  # of the block's first document
                ids.append(i)
                held.append(h)
                texts.append(t or b"")
                size += len(texts[-1])
                if size >= BLOCK_BYTES or len(texts) >= 100_000:
                    yield flush()
                    ids, held, texts, size = [], [], [], 0
        if texts:
            yield flush()

    named = docs.withColumn("row", F.monotonically_increasing_id()).select("doc_id", "held_out", "text", "row")
    return named.mapInArrow(run, "block long, doc_ids array<long>, held array<boolean>, sizes array<long>, z binary")


def _texts(z: bytes, sizes: list[int]) -> list[bytes]:
    data, ends = zstandard.decompress(z), np.cumsum(sizes).tolist()
    return [data[e - n : e] for e, n in zip(ends, sizes, strict=True)]


def _counted(blocks: DataFrame, shards: int) -> DataFrame:
    """(shard, kind, part, names, counts) of training tokens (kind 1) and pairs (kind 2), summed in tasks; part is the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, one = TaskContext.get().partitionId(), []
        two: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, parts in ((1, one), (2, two)):
                x, n = np.unique(np.concatenate(parts), return_counts=True)
                order, cut = by_shard(x, shards)
                x, n = x[order], n[order]
                some = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_pydict({"shard": pa.array(some), "kind": pa.array(np.full(len(some), kind, np.int32)), "part": pa.array(np.full(len(some), part, np.int64)), "names": pa.array([press_sorted(x[cut[s] : cut[s + 1]]) for s in some], pa.binary()), "counts": pa.array([press(n[cut[s] : cut[s + 1]]) for s in some], pa.binary())})
            one.clear()
            two.clear()

        for b in batches:
            for z, sizes, held in zip(b.column("z").to_pylist(), b.column("sizes").to_pylist(), b.column("held").to_pylist(), strict=True):
                for hs, texts in chunks(held, _texts(z, sizes)):
                    if texts := [t for t, h in zip(texts, hs, strict=True) if not h]:
                        t, _ = tokens(texts)
                        one.append(t[1:])
                        two.append(pairs(t))
                if sum(map(len, one)) >= FLUSH:
                    yield from flush()
        if one:
            yield from flush()

    return blocks.select("z", "sizes", "held").mapInArrow(run, COUNTED)


COUNTED = "shard long, kind int, part long, names binary, counts binary"


def _added(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    x = np.concatenate([unpress_sorted(b) for b in rows["names"]] or [np.zeros(0, np.uint64)])
    return summed(x, np.concatenate([unpress(b, np.int64) for b in rows["counts"]] or [np.zeros(0, np.int64)]))


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows of one shard, kind and part as one."""
    x, n = _added(pdf)
    return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "kind": pdf["kind"].iloc[:1], "part": pdf["part"].iloc[:1], "names": [press_sorted(x)], "counts": [press(n)]})


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """A shard's row: its words with counts, how many of them have a count of 2^k and more up to the next, its filter segment."""
    out = {"shard": [int(pdf["shard"].iat[0])]}
    for kind in (1, 2):
        x, n = _added(pdf[pdf["kind"] == kind])
        if kind == 1:
            out |= {"names": [press_sorted(x)], "counts": [press(n)], "tokens": [int(n.sum())], "types": [len(x)], "kinds": [np.bincount(_slot(n), minlength=40).tolist()]}
        else:
            out |= {"segment": [build_filter(x, n)]}
    return pd.DataFrame(out)


SHARD = "shard long, names binary, counts binary, tokens long, types long, kinds array<long>, segment binary"


def hot_words(model: DataFrame, kinds: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent words and their counts: those with a count of 2^k and more, for the least k with at most `most`."""
    behind = np.cumsum(kinds[::-1])[::-1]
    least = 1 << int((behind > most).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for names, counts in zip(b.column("names").to_pylist(), b.column("counts").to_pylist(), strict=True):
                x, n = unpress_sorted(names), unpress(counts, np.int64)
                some = n >= least
                yield pa.RecordBatch.from_arrays([pa.array([press_sorted(x[some])], pa.binary()), pa.array([press(n[some])], pa.binary())], names=["names", "counts"])

    found = model.select("names", "counts").mapInArrow(run, "names binary, counts binary").collect()  # `most` words
    return _added(pd.DataFrame(found, columns=["names", "counts"]))


def _found(x: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Which names are among sorted x."""
    return x[np.minimum(np.searchsorted(x, names), len(x) - 1)] == names if len(x) else np.zeros(len(names), bool)


def _asked(blocks: DataFrame, shards: int, kind: int, hot: np.ndarray) -> DataFrame:
    """(shard, block, names): distinct words that aren't hot (kind 1) or pairs (kind 2) of each block."""
    known = blocks.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, z, sizes in zip(b.column("block").to_pylist(), b.column("z").to_pylist(), b.column("sizes").to_pylist(), strict=True):
                t, _ = tokens(_texts(z, sizes))
                x = np.unique(t if kind == 1 else pairs(t))
                if kind == 1:
                    x = x[~_found(known.value, x)]
                order, cut = by_shard(x, shards)
                x, some = x[order], np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_pydict({"shard": pa.array(some), "block": pa.array(np.full(len(some), block)), "names": pa.array([press_sorted(x[cut[s] : cut[s + 1]]) for s in some], pa.binary())})

    return blocks.select("block", "z", "sizes").mapInArrow(run, "shard long, block long, names binary")


def _told(asked: DataFrame, model: DataFrame, kind: int, shards: int) -> DataFrame:
    """(block, kind, names, counts): what the shards know; pairs' counts are levels.

    In a task, a shard's own row comes before the questions to it, which then pass one by one, however many there are.
    """
    knows = F.col("counts") if kind == 1 else F.col("segment")
    own = model.select("shard", F.lit(None).cast("long").alias("block"), ("names" if kind == 1 else F.lit(None).cast("binary").alias("names")), knows.alias("knows"))
    both = own.unionByName(asked.select("shard", "block", "names", F.lit(None).cast("binary").alias("knows")))
    tasks = max(shuffle_width(model.sparkSession), -(-shards // 8))
    dealt = both.repartition(tasks, "shard").sortWithinPartitions("shard", F.col("block").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, x, n, segment = None, None, None, None
        for b in batches:
            blocks, names, counts = [], [], []
            for shard, block, asks, knows in zip(*(b.column(c).to_pylist() for c in ("shard", "block", "names", "knows")), strict=True):
                if block is None:
                    at = shard
                    if kind == 1:
                        x, n = unpress_sorted(asks), unpress(knows, np.int64)
                    else:
                        segment = Filter([knows])
                    continue
                q = unpress_sorted(asks)
                if at != shard:
                    found = np.zeros(len(q), np.int64)  # a shard that has learned nothing
                elif kind == 2:
                    found = segment.levels(q)
                else:
                    found = np.where(_found(x, q), n[np.minimum(np.searchsorted(x, q), len(x) - 1)], 0) if len(x) else np.zeros(len(q), np.int64)
                blocks.append(block)
                names.append(asks)
                counts.append(press(found))
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array([kind] * len(blocks), pa.int32()), pa.array(names, pa.binary()), pa.array(counts, pa.binary())], names=["block", "kind", "names", "counts"])

    return dealt.select("shard", "block", "names", "knows").mapInArrow(run, "block long, kind int, names binary, counts binary")


class Tables:
    """What a block knows: counts of hot words and of those it was told, and levels of its pairs, by filter or as told."""

    def __init__(self, told: pd.DataFrame, hot: tuple[np.ndarray, np.ndarray], filter: Filter | None):
        self.one, self.hot, self.filter = self._table(told[told["kind"] == 1]), hot, filter
        self.two = None if filter is not None else self._table(told[told["kind"] == 2])

    @staticmethod
    def _table(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        x = np.concatenate([unpress_sorted(b) for b in rows["names"]] or [np.zeros(0, np.uint64)])
        n = np.concatenate([unpress(b, np.int64) for b in rows["counts"]] or [np.zeros(0, np.int64)])
        order = np.argsort(x)
        return x[order], n[order]

    def count(self, t: np.ndarray) -> np.ndarray:
        once = np.unique(t)
        out = np.zeros(len(once), np.int64)
        for x, n in (self.hot, self.one):  # a word is in one of both
            there = np.flatnonzero(_found(x, once))
            out[there] = n[np.searchsorted(x, once[there])]
        return out[np.searchsorted(once, t)]

    def level(self, p: np.ndarray) -> np.ndarray:
        if self.two is not None:
            return self.two[1][np.searchsorted(self.two[0], p)]
        once, at = np.unique(p, return_inverse=True)  # frequent pairs have the most levels
        return self.filter.levels(once)[at]


def _slot(context: np.ndarray) -> np.ndarray:
    """Contexts by the logarithm of their count."""
    return np.minimum(np.log2(np.maximum(context, 1)).astype(np.int64), 39)


def _rated(c: np.ndarray, level: np.ndarray, total: int, types: int) -> tuple[np.ndarray, ...]:
    """For each token but the first: its count, its add-one probability, the context's count, and the pair's count."""
    return c[1:], (c[1:] + 1.0) / (total + types + 1.0), c[:-1], np.where(c[:-1] > 0, count_of(level), 0.0)


def mixture(histogram: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights of the pair's share for each slot; histogram: (slot, bin) tokens by how many times likelier the share is."""
    ratio = np.concatenate([[0.0], 2.0 ** (np.arange(1, histogram.shape[1]) - 16.0)])
    weight = np.full(len(histogram), 0.3)
    for _ in range(rounds):
        share = weight[:, None] * ratio / (weight[:, None] * ratio + 1 - weight[:, None])
        weight = np.clip(((histogram * share).sum(1) + 0.3) / (histogram.sum(1) + 1), 1e-4, 0.95)
    return weight


RATED = "doc_ids array<long>, held array<boolean>, sizes array<long>, kinds binary, counts binary, levels binary, cells array<long>, n array<long>"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_all(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text, held_out): n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the text's words and an end. The model is learned from the rows whose held_out is false (null counts as
    false). base_score sums the log10 of add-one probabilities, score of the mixture's. A null or empty text has the end
    token alone. Rows with the same or no doc_id are kept; other columns aren't read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = own_columns(docs, "doc_id", "text", "held_out").withColumn("held_out", F.coalesce("held_out", F.lit(False)))
    blocks = stash(_blocks(docs), "blocks")
    size = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    counted, tables = _counted(blocks, shards), size / (4 * FLUSH)  # of about that many bytes each
    while tables > FAN:
        counted, tables = counted.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("shard", "kind", "part").applyInPandas(_add, COUNTED), tables / FAN
    model = stash(counted.groupBy("shard").applyInPandas(_merge, SHARD), "model")
    sums = model.agg(F.sum("tokens"), F.sum("types"), F.sum(F.octet_length("segment"))).first()
    total, types, filter_bytes = (x or 0 for x in sums)
    kinds = np.zeros(40, np.int64)
    for r in model.select(F.posexplode("kinds").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect():
        kinds[r["k"]] = r["n"]
    hot = hot_words(model, kinds, HOT)
    told = _told(_asked(blocks, shards, 1, hot[0]), model, 1, shards)
    given = spark.sparkContext.broadcast(hot)
    shared = None
    if filter_bytes <= FILTER_BYTES:
        segments = [bytes(8)] * shards
        for r in model.select("shard", "segment").toLocalIterator():
            segments[r["shard"]] = bytes(r["segment"])
        shared = spark.sparkContext.broadcast(Filter(segments))
        del segments
    else:
        told = told.unionByName(_told(_asked(blocks, shards, 2, hot[0]), model, 2, shards))
    told = stash(told, "told")
    drop(model)

    def known(right: pd.DataFrame) -> Tables:
        return Tables(right, given.value, None if shared is None else shared.value)

    def rate(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Texts' counts and levels for the scores, and what their training tokens add to the histogram."""
        tables, rows = known(right), []
        for ids, held, z, sizes in zip(left["doc_ids"], left["held"], left["z"], left["sizes"], strict=True):
            for own, texts in chunks(list(zip(ids, held, strict=True)), _texts(z, sizes), BLOCK_BYTES):
                t, n = tokens(texts)
                count, level = tables.count(t), tables.level(pairs(t))
                _, alone, context, pair = _rated(count, level, total, types)
                own_held = np.array([bool(h) for _, h in own])
                learned = np.repeat(~own_held, n + 1)
                pair, context, alone = np.maximum(pair[learned] - 1, 0.0), context[learned], alone[learned]  # without this occurrence
                ratio = pair / np.maximum(context - 1, 1) / alone
                place = np.where(pair > 0, np.clip(np.round(np.log2(np.maximum(ratio, 1e-9))) + 16, 1, 47), 0).astype(np.int64)
                cells = np.bincount(_slot(context) * 48 + place, minlength=40 * 48)
                some = np.flatnonzero(cells)
                rows.append(([None if i is None or i != i else int(i) for i, _ in own], own_held, n + 1, *press_few(count), press(level.astype(np.uint8)), some, cells[some]))
        return pd.DataFrame(rows, columns=["doc_ids", "held", "sizes", "kinds", "counts", "levels", "cells", "n"])

    rated = stash(blocks.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(rate, RATED), "rated")
    drop(blocks, told)
    histogram = np.zeros(40 * 48)
    for r in rated.select(F.explode(F.arrays_zip("cells", "n")).alias("c")).groupBy("c.cells").agg(F.sum("c.n").alias("n")).collect():
        histogram[r["cells"]] = r["n"]
    weight = mixture(histogram.reshape(40, 48))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                ids, held, sizes, kinds, counts, level = (b.column(c)[k] for c in ("doc_ids", "held", "sizes", "kinds", "counts", "levels"))
                count, alone, context, pair = _rated(unpress_few(kinds.as_py(), counts.as_py()), unpress(level.as_py(), np.uint8), total, types)
                w = np.where(context > 0, weight[_slot(context)], 0.0)
                p = w * np.minimum(pair / np.maximum(context, 1), 1.0) + (1 - w) * alone
                n = sizes.values.to_numpy()
                starts = np.cumsum(n) - n
                out = {"doc_id": ids.values, "held_out": held.values, "n_tokens": pa.array(n), "n_known": pa.array(np.add.reduceat((count > 0).astype(np.int64), starts)), "train_tokens": pa.array(np.full(len(n), total, np.int64)), "base_score": pa.array(np.add.reduceat(np.log10(alone), starts)), "score": pa.array(np.add.reduceat(np.log10(p), starts))}
                yield pa.RecordBatch.from_pydict(out)

    return rated.select("doc_ids", "held", "sizes", "kinds", "counts", "levels").mapInArrow(score, SCORES)


def held_out_scores(docs: DataFrame) -> DataFrame:
    """The query: rows whose crc32(doc_id) mod 7 is 2 are held out."""
    return score_all(own_columns(docs, "doc_id", "text").withColumn("held_out", crc32_text(F.col("doc_id")) % 7 == 2))


