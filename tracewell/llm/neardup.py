"""Near-duplicate documents by MinHash bands and sequential Bayesian verification.

Documents with the same set of shingles form a class, which its smallest doc_id stands for. Classes that agree on all
rows of a band of their MinHash signatures share a bucket. Pairs from buckets are compared one batch of signature
values at a time: with m agreements in n values and a uniform prior, the similarity's posterior is Beta(m + 1, n - m + 1),
and once it lies above the threshold with less than the chosen miss probability the pair is dropped. Survivors are
verified on their full sets. Links join classes to components.

Within a bucket not all pairs are taken. First each class is compared with the smallest class of all its buckets; then with
each bucket's own hub, unless it is in the hub's component by now. What is left are pairs in different components. Tasks
look for survivors among them, one block of a bucket against another, and give only a spanning forest of what they find.
The forests' components are verified in the same manner, again giving forests. Pairs in one component can't change the
result, so nothing is lost; no table holds a row for each pair, and a group of near copies costs a few rows a member.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import as_bytes, blobs, chunks, components, compressed, drop, forest, groups, joined_on, mix, own_columns, remembered, sieve, sift, slices, spots, stash, unsqueezed
from tracewell.llm.shingles import shingle_set, words

#: Bands and rows of a signature. At a similarity of 0.85 a pair shares no band with probability 1.2e-5, at 0.8 with 6e-4 a
#: pair, so lower thresholds take more, shorter bands: see `bands_for`.
BATCH = 24
#: Probability of dropping a pair over the threshold in one comparison of batches.
MISS = 1e-6
#: Classes of a block, and bytes of full sets; a task compares two blocks.
BLOCK, SET_BYTES = 512, 32 << 20


def bands_for(threshold: float, miss: float = 2e-5) -> tuple[int, int]:
    """(bands, rows) with the most rows whose bands miss a pair at the threshold with at most that probability."""
    for rows in (6, 5, 4, 3, 2):
        bands = math.ceil(math.log(miss) / math.log(1 - threshold**rows))
        if bands * rows <= 192:
            return bands, rows
    return 192, 1


def permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    a = mix(np.arange(1, 2 * k + 1, dtype=np.uint64))
    return a[:k] | np.uint64(1), a[k:]


def signatures(sets: list[np.ndarray], k: int) -> np.ndarray:
    """Row i has k MinHash values of the non-empty set i."""
    a, b = permutations(k)
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((k, len(sets)), dtype=np.uint32)
    high, buffer = np.uint64(32), np.empty_like(flat)
    for j in range(k):
        np.multiply(flat, a[j], out=buffer)
        buffer += b[j]
        np.right_shift(buffer, high, out=buffer)
        out[j] = np.minimum.reduceat(buffer, starts)
    return np.ascontiguousarray(out.T)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each signature and band."""
    parts = sig.reshape(len(sig), bands, rows).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), bands)).copy()
    for j in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return out


def least_matches(threshold: float, n: int, miss: float = MISS) -> int:
    """Fewest agreements in n values with which P(similarity >= threshold) is still at least `miss`.

    That probability is P(Binomial(n + 1, threshold) <= m).
    """
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def survivors(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of signatures (x[i], y[j]) are left after all batches."""
    alive, same = np.arange(len(i)), np.zeros(len(i), dtype=np.int32)
    for at in range(0, x.shape[1], BATCH):
        to = min(at + BATCH, x.shape[1])
        same = same + (x[i[alive], at:to] == y[j[alive], at:to]).sum(1)
        keep = same >= least_matches(threshold, to)
        alive, same = alive[keep], same[keep]
        if not len(alive):
            break
    return alive


def fixed(column: pa.Array, dtype: type) -> np.ndarray:
    """A binary column whose values have one length, as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(len(column), -1)


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether sorted sets are similar enough."""
    both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def tiles(members: DataFrame, keys: list[str]) -> DataFrame:
    """members (keys, id, component, blocks of the key), once for each pair (i, j) of blocks that their own is in."""
    blocks = F.col("blocks").cast("int")
    dealt = members.withColumn("block", F.pmod(F.xxhash64("id", F.lit(7)), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return dealt.select(*keys, "id", "component", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))


def cross_pairs(g: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a tile's rows, one of block i and one of block j, in different components."""
    ids, component, block = (g.column(c).to_numpy(zero_copy_only=False) for c in ("id", "component", "block"))
    i, j = g.column("i")[0].as_py(), g.column("j")[0].as_py()
    one, two = (np.flatnonzero(block == i), np.flatnonzero(block == j)) if i != j else (np.arange(len(ids)),) * 2
    apart = component[one][:, None] != component[two][None]
    if i == j:
        apart &= ids[one][:, None] < ids[two][None]
    x, y = np.nonzero(apart)
    return one[x], two[y]


def spanning(ids: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    """Links that join what the links ids[x], ids[y] join, at most one for each id."""
    root = forest(len(ids), x, y)
    some = np.flatnonzero(root != np.arange(len(ids)))
    return pa.RecordBatch.from_arrays([pa.array(ids[root[some]]), pa.array(ids[some])], names=["a", "b"])


def _signed(docs: DataFrame, shingle: int, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered(None)
        for b in chain.from_iterable(map(slices, batches)):
            for ids, texts in chunks(b.column("doc_id").to_pylist(), as_bytes(b.column("text"))):
                sets = [shingle_set(words(t), shingle) for t in texts]
                full = [s for s in sets if len(s)]
                sig = iter(signatures(full, k)) if full else iter(())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), pa.array([next(sig).tobytes() if len(s) else None for s in sets], pa.binary())],
                    names=["doc_id", "n_shingles", "digest", "sig"],
                )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary, sig binary")


def sieved(docs: DataFrame, bits: np.ndarray, squeeze: bool = False) -> DataFrame:
    """Rows of docs (doc_id, text) whose id may be among those of the sieve; with `squeeze`, the text is compressed, in z.

    Both are done in one step, as a task has a worker for each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sift(batches, shared.value)
        if squeeze:
            yield from compressed(rows, ["doc_id"])
        else:
            for b in rows:
                yield b.select(["doc_id", "text"])

    return docs.select("doc_id", "text", *spots("doc_id")).mapInArrow(run, "doc_id long, " + ("z binary" if squeeze else "text string"))


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered(None)
        for b in chain.from_iterable(map(slices, batches)):
            for _, texts in chunks([None] * b.num_rows, unsqueezed(b.column("z"))):
                sets = [shingle_set(words(t), shingle) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), blobs(np.concatenate(sets), [len(s) for s in sets])], names=["digest", "shingles"])

    return docs.select("z").mapInArrow(run, "digest binary, shingles binary")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text).

    Documents are linked when 100 * |intersection| >= percent * |union| of their sets of distinct `shingle`-word shingles.
    component_id is the smallest doc_id reachable by links. A null or empty text, or one without words, has no shingles
    and no links. Rows with the same doc_id are one node with the links of all. A row with a null doc_id takes the component
    of what it equals, else null, and is kept only if null. Other columns aren't read; an empty table gives no rows.
    """
    threshold = percent / 100
    bands, rows = bands_for(threshold)
    k = bands * rows
    docs = own_columns(docs, "doc_id", "text")
    signed = stash(_signed(docs, shingle, k), "signed")
    # A class is a node with a number of its own: rows that share a doc_id may be in several.
    classes = signed.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig")).where("doc_id is not null")
    reps = stash(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    rows_of = stash(signed.where("digest is not null").select("doc_id", "n_shingles", "digest").join(reps.select("digest", "id"), "digest", "left").select("doc_id", "n_shingles", "id"), "rows")
    one_id = rows_of.where("doc_id is not null and id is not null").groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a <> z").select("doc_id", "a")
    same_id = stash(rows_of.where("id is not null").join(one_id, "doc_id").where("id <> a").select("a", F.col("id").alias("b")).distinct(), "same")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                found = band_keys(fixed(b.column("sig"), np.uint32), bands, rows)
                ids = b.column("id").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(found.reshape(-1).view(np.int64)), pa.array(np.tile(np.arange(bands, dtype=np.int32), len(ids))), pa.array(np.repeat(ids, bands))], names=["key", "band", "id"])

    members = reps.mapInArrow(keys, "key long, band int, id long")
    sizes = members.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.min_by("id", F.xxhash64("id", "key")).alias("hub")).where("n > 1")
    buckets = stash(members.join(sizes, "key"), "buckets")
    sig = stash(reps.join(buckets.select("id").distinct(), "id", "left_semi"), "shared")
    # The sieve keeps most of the other texts from being compressed and shuffled; the join is exact.
    wanted = sig.select("doc_id").distinct()
    texts = sieved(docs, sieve(wanted), squeeze=True).join(wanted, "doc_id", "left_semi")
    texts = stash(texts, "texts")  # else tasks run workers for sieving and for sets side by side
    sets = stash(_sets(texts, shingle).join(sig.select("digest", "id"), "digest").dropDuplicates(["digest"]).select("id", "shingles"), "sets")
    drop(texts)
    sig = sig.select("id", "sig")

    def pruned(pairs: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    n = np.arange(b.num_rows)
                    alive = survivors(fixed(b.column("sig_a"), np.uint32), fixed(b.column("sig_b"), np.uint32), n, n, threshold)
                    yield b.select(["a", "b"]).take(pa.array(alive))

        both = pairs.join(sig.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), "a").join(sig.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b")
        return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")

    def verified(pairs: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                good = []
                for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                    good.append(linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent))
                yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

        pairs = stash(pairs, "pairs")  # else tasks run workers for pruning and verifying side by side
        full = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
        return full.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")

    def apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
        """The pairs whose ends lie in different components."""
        at = found.select(F.col("id"), F.col("component"))
        a = pairs.join(at.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left")
        return a.join(at.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")

    pairs_with_hub = buckets.where("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    lowest = buckets.groupBy("id").agg(F.min("low").alias("b")).where("id > b").select(F.col("b").alias("a"), F.col("id").alias("b"))
    found = components(verified(pruned(lowest)).unionByName(same_id))
    found = stash(joined_on(found, stash(verified(pruned(apart(pairs_with_hub, found))), "links")), "found")

    # What is left: buckets with more than one component.
    where = buckets.where("n > 2").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = where.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select("key")
    where = where.join(mixed, "key", "left_semi").withColumn("blocks", F.ceil(F.col("n") / BLOCK))
    left = tiles(where, ["key", "band"]).join(sig, "id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["key", "i", "j"]):
            ids, s = g.column("id").to_numpy(), fixed(g.column("sig"), np.uint32)
            x, y = cross_pairs(g)
            if len(x):
                before = band_keys(s, bands, rows)[:, : g.column("band")[0].as_py()]  # a pair counts in the first band it shares
                first = ~(before[x] == before[y]).any(1)
                x, y = x[first], y[first]
                alive = survivors(s, s, x, y, threshold)
                yield spanning(ids, x[alive], y[alive])

    near = components(stash(left.select("key", "band", "id", "component", "block", "i", "j", "sig").mapInArrow(across, "a long, b long"), "survivors"), "survivors")
    near = near.withColumnRenamed("component", "near")
    near = near.join(sets.select("id", F.octet_length("shingles").alias("size")), "id")
    blocks = F.greatest(F.ceil(F.count("*") / (BLOCK // 2)), F.ceil(F.sum("size") / SET_BYTES))
    near = near.join(near.groupBy("near").agg(blocks.alias("blocks")), "near").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    rest = tiles(near, ["near"]).join(sig, "id").join(sets, "id").repartition("near", "i", "j").sortWithinPartitions("near", "i", "j")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["near", "i", "j"]):
            ids, s = g.column("id").to_numpy(), fixed(g.column("sig"), np.uint32)
            x, y = cross_pairs(g)
            if len(x):
                full = [np.frombuffer(v, np.uint64) for v in g.column("shingles").to_pylist()]
                alive = survivors(s, s, x, y, threshold)
                good = np.array([linked(full[i], full[j], percent) for i, j in zip(x[alive], y[alive], strict=True)], dtype=bool)
                yield spanning(ids, x[alive][good], y[alive][good])

    found = stash(joined_on(found, stash(rest.select("near", "id", "component", "block", "i", "j", "sig", "shingles").mapInArrow(settle, "a long, b long"), "links")), "found")
    drop(buckets, sets)

    # By classes first, so that what joins the rows has one row for each, and rows of a large class can be split.
    named = reps.select("id", "doc_id").join(found, "id", "left").select("id", "doc_id", F.coalesce("component", "id").alias("node"))
    first = named.groupBy("node").agg(F.min("doc_id").alias("class_id"))
    named = stash(named.join(first, "node").select("id", "class_id"), "named")
    # Rows without a class have no shingles, or no doc_id and no equal that has one.
    alone = signed.where("digest is null").select("doc_id", "n_shingles").unionByName(rows_of.where("id is null").select("doc_id", "n_shingles"))
    out = rows_of.where("id is not null").join(named, "id").select("doc_id", "n_shingles", "class_id").unionByName(alone.withColumn("class_id", F.lit(None).cast("long")))
    component = F.coalesce("class_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


#: The query (three words, 85 %) in DuckDB SQL; all pairs that share a shingle meet.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + n - 1], ' ') AS x FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM (SELECT *, least(3, len(w)) AS n FROM d) WHERE n > 0)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN z u ON u.doc_id = a JOIN z v ON v.doc_id = b WHERE 100 * shared >= 85 * (u.n + v.n - shared)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT DISTINCT a AS id, a AS root FROM l UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id, coalesce(c.component_id, d.doc_id) IS NOT DISTINCT FROM d.doc_id AS kept
FROM d LEFT JOIN z USING (doc_id) LEFT JOIN c ON c.id = d.doc_id
"""
