"""Near-duplicate vectors by collision counting on sorted projections.

Vectors are compared within a label. Equal vectors form a class, which one of them stands for with their number. Random
hyperplanes give each class a cell in each of several tables; more and smaller cells as the largest label grows, and as
many tables as leave a pair at the threshold without a common cell with probability CELL_MISS. In a cell, each of
PROJECTIONS random directions sorts the classes; around each class as the query a window of the sorted order is
collided with, and pairs with at least `least_collisions` collisions are verified by their cosine in double precision.
Window and count are calibrated for a pair at the threshold: projections of its difference are normal, and the pair
passes the count with probability 1 - COUNT_MISS.

A pair is counted in the first table in which it shares a cell, so tasks agree without exchanging pairs: they give each
class its number of links and a spanning forest of what they have linked. Large cells are taken in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import components, forest, groups, joined_evenly, own_columns, ragged, spans, stash

CELL_MISS, COUNT_MISS = 2e-4, 5e-4
PROJECTIONS = 16
#: Half a window, in standard deviations of a threshold pair's projected difference.
WIDTH = 2.0
#: Classes of a block, and the mean number in a cell that tables aim for.
BLOCK, CELL = 768, 64


def tables_for(threshold: float, largest: int) -> tuple[int, int]:
    """(tables, bits of a cell's name) for a label with `largest` classes."""
    bits = min(24, max(2, round(math.log2(max(largest, 1) / CELL))) if largest > CELL else 2)
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(CELL_MISS) / math.log(1 - same)), bits


def least_collisions(miss: float = COUNT_MISS) -> int:
    p = math.erf(WIDTH / math.sqrt(2))
    total = 0.0
    for k in range(PROJECTIONS + 1):
        total += math.comb(PROJECTIONS, k) * p**k * (1 - p) ** (PROJECTIONS - k)
        if total > miss:
            return k
    return PROJECTIONS


def directions(dim: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, n))


def packed(x: np.ndarray) -> bytes:
    """A vector's bytes, in single precision where that loses nothing."""
    with np.errstate(over="ignore"):
        short = x.astype(np.float32)
    return (short if (short == x).all() else x).tobytes()


def unpacked(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows, in double precision."""
    blobs = column.to_pylist()
    if {len(b) for b in blobs} <= {4 * dim}:
        return np.frombuffer(b"".join(blobs), np.float32).reshape(-1, dim).astype(np.float64)
    return np.array([np.frombuffer(b, np.float32 if len(b) == 4 * dim else np.float64) for b in blobs], np.float64)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows multiplied by powers of two, so that squares of their components neither overflow nor vanish."""
    _, power = np.frexp(np.abs(x).max(axis=1))
    return np.ldexp(x, -power[:, None])


def collisions(x: np.ndarray, y: np.ndarray, width: float) -> np.ndarray:
    """How often y[j] is in the window around x[i], over all columns, as a matrix. Columns are sorted side by side."""
    m, n, k = len(x), len(y), x.shape[1]
    apart = max(np.abs(x).max(), np.abs(y).max()) * 2 + 4 * width + 1
    shift = np.arange(k) * apart
    flat = (y + shift).T.reshape(-1)  # column after column
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    queries = (x + shift).T.reshape(-1)
    lo, hi = np.searchsorted(flat, queries - width, "left"), np.searchsorted(flat, queries + width, "right")
    size = hi - lo
    hit = order[np.repeat(lo, size) + spans(size)] % n
    return np.bincount(np.repeat(np.tile(np.arange(m), k), size) * n + hit, minlength=m * n).reshape(m, n)


def link_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding, label).

    Rows with equal labels and embeddings of equal length are linked when their cosine is at least `threshold`. A row with a
    null label, or an embedding that is null, empty, zero, or holds null or non-finite components, links with nothing; its
    component is its own vec_id. Equal vectors are linked with one another and have the same other links; n_links counts
    rows, and rows with one vec_id are judged each by its own vector. A row with a null vec_id has its links' component, else
    null. Components may be as small or large as doubles are. Other columns aren't read.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, raw, dims = [], [], []
            for label, v in zip(b.column("label").to_pylist(), b.column("embedding"), strict=True):
                x = None
                if label is not None and v.is_valid and len(v.values) and not v.values.null_count:
                    x = np.asarray(v.values).astype(np.float64) + 0.0  # one zero
                    x = x if np.isfinite(x).all() and x.any() else None
                keys.append(None if x is None else xxhash.xxh3_128_digest(x.tobytes()))
                raw.append(None if x is None else packed(x))
                dims.append(0 if x is None else len(x))
            yield pa.RecordBatch.from_arrays([b.column("vec_id").cast(pa.int64()), b.column("label").cast(pa.int64()), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())], names=["vec_id", "label", "key", "dim", "vec"])

    rows = stash(own_columns(vectors, "vec_id", "embedding", "label").mapInArrow(keyed, "vec_id long, label long, key binary, dim int, vec binary"), "vectors")
    classes = rows.where("key is not null").groupBy("label", "dim", "key").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
    classes = stash(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    largest = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 1
    tables, bits = tables_for(threshold, largest)

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = 1 << np.arange(bits, dtype=np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                part = b.take(pa.array(at))
                x = scaled(unpacked(part.column("vec"), int(dim)))
                cells = ((x @ directions(dim, tables * bits, 1) > 0).reshape(len(at), tables, bits) * powers).sum(2)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("label", "dim", "id", "copies", "vec")), ragged(cells.astype(np.int32).reshape(-1), np.full(len(at), tables))], names=["label", "dim", "id", "copies", "vec", "cells"])

    in_cells = classes.select("label", "dim", "id", "copies", "vec").mapInArrow(celled, "label long, dim int, id long, copies long, vec binary, cells array<int>")
    members = in_cells.select("*", F.posexplode("cells").alias("tab", "cell"))
    sizes = members.groupBy("label", "dim", "tab", "cell").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = members.join(sizes, ["label", "dim", "tab", "cell"]).withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), blocks).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    keys = ["label", "dim", "tab", "cell", "i", "j"]
    dealt = dealt.select(*keys, "block", "id", "copies", "vec", "cells").repartition(*keys).sortWithinPartitions(*keys)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = least_collisions()
        for g in groups(batches, keys):
            if g.num_rows < 2:
                continue
            dim, tab, i, j = (g.column(c)[0].as_py() for c in ("dim", "tab", "i", "j"))
            ids, copies, block = (g.column(c).to_numpy(zero_copy_only=False) for c in ("id", "copies", "block"))
            x = scaled(unpacked(g.column("vec"), dim))
            x = x / np.linalg.norm(x, axis=1)[:, None]
            before = np.asarray(g.column("cells").flatten()).reshape(len(ids), -1)[:, :tab]
            one, two = (np.flatnonzero(block == i), np.flatnonzero(block == j)) if i != j else (np.arange(len(ids)),) * 2
            if not len(one) or not len(two):
                continue
            u = directions(dim, PROJECTIONS, 2)
            p = x @ u
            count = collisions(p[one], p[two], WIDTH * math.sqrt(2 - 2 * threshold))
            a, b = np.nonzero(count >= least)
            a, b = one[a], two[b]
            if i == j:
                a, b = a[a < b], b[a < b]
            near = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
            a, b = a[near], b[near]
            fresh = ~(before[a] == before[b]).any(1)
            a, b = a[fresh], b[fresh]
            if not len(a):
                continue
            n = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
            root = forest(len(ids), a, b)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(n[some].astype(np.int64)), pa.array(ids[root[some]])], names=["id", "n", "root"])

    found = stash(dealt.mapInArrow(link, "id long, n long, root long"), "links")
    linked = found.groupBy("id").agg(F.sum("n").alias("n"))
    parts = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    known = classes.select("label", "dim", "key", "id", "least", "copies").join(linked, "id", "left").join(parts, "id", "left")
    known = stash(known.select("label", "dim", "key", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("part")), "known")
    # Components by their smallest vec_id, which classes without one haven't.
    known = joined_evenly(known, known.groupBy("part").agg(F.min("least").alias("class_id")), ["part"]).drop("least", "part")
    out = rows.select("vec_id", "label", "dim", "key").join(known, ["label", "dim", "key"], "left")
    component = F.coalesce("class_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


#: The query in DuckDB SQL; all pairs of a label meet.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT DISTINCT a AS id, a AS root FROM l UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id),
n AS (SELECT a AS id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.id = vec_id LEFT JOIN c ON c.id = vec_id
"""
