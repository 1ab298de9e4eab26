"""Product codes of vectors, with exact nearest entries found by annular norm pruning.

Components become integers. A vector is cut into equal parts, and each part position has a codebook of integer entries,
which begins with that part of the first vectors and is refined in rounds: every part goes to its nearest entry, and each
entry becomes the floored mean of its parts. A code names the nearest entry of each part.

Entries are sorted by norm. Of an entry at distance d of a part, the norms differ by d at most, so once some entry is known
to be d away, only entries whose norms lie in the annulus of that width can be as near: binary search finds them, and their
distances are taken exactly, in integers. Equal distances go to the lower index.

Codebooks have ENTRIES * dimension numbers whatever the table's size, and are all that goes through the driver. Sums of
parts are added up within tasks first.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import joined_evenly, own_columns, spans, stash

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256


def limit(dim: int) -> int:
    """Components below this size leave all sums of a row exact in 64 bits."""
    return math.isqrt((1 << 60) // (max(dim, 1) * ENTRIES))


def read_vectors(column: pa.Array | pa.ChunkedArray, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(kept, able, starts, values): whether a row is kept, how long its vector is if it can be coded (else 0), where that
    starts among the integer values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = np.asarray(column.offsets).astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    with np.errstate(over="ignore", invalid="ignore"):
        bad = ~np.isfinite(values)
        values = np.floor(values * scale)
        long = np.diff(ends)
        most = limit(int(long.max(initial=1)))
        large = ~(np.abs(values) < most)
    within = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[ends]) > 0
    kept = column.is_valid().to_numpy(zero_copy_only=False) & ~within(bad)
    able = np.where(kept & ~within(large) & (long % PARTS == 0), long, 0)
    return kept, able, ends[:-1], np.where(large, 0, values).astype(np.int64)


def gathered(rows: np.ndarray, dim: int, starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    return values[starts[rows][:, None] + np.arange(dim)]


class Codebook:
    """Entries of one part position, sorted by norm."""

    def __init__(self, entries: np.ndarray):
        self.n = len(entries)
        norms = np.sqrt((entries * entries).sum(1).astype(np.float64))
        self.order = np.argsort(norms, kind="stable")
        self.norms, self.sorted = norms[self.order], entries[self.order]

    def _keys(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Squared distances of x to the entries at places in the norms' order, with their indexes in the lowest digits."""
        gap = x - self.sorted[at]
        return (gap * gap).sum(1) * self.n + self.order[at]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each part's nearest entry, exactly."""
        norm = np.sqrt((x * x).sum(1).astype(np.float64))
        right = np.clip(np.searchsorted(self.norms, norm), 0, self.n - 1)
        best = self._keys(x, right)
        best = np.minimum(best, self._keys(x, np.maximum(right - 1, 0)))
        far = np.sqrt((best // self.n).astype(np.float64))
        slack = 1e-9 + 1e-12 * (norm + far)  # more than roots are rounded by
        low = np.searchsorted(self.norms, norm - far - slack, "left")
        size = np.searchsorted(self.norms, norm + far + slack, "right") - low
        some = np.flatnonzero(size)
        low, size = low[some], size[some]
        place = np.repeat(low, size) + spans(size)
        if len(some):
            keys = self._keys(np.repeat(x[some], size, axis=0), place)
            best[some] = np.minimum(best[some], np.minimum.reduceat(keys, np.cumsum(size) - size))
        return best % self.n, best // self.n


def _parts(x: np.ndarray) -> list[np.ndarray]:
    return np.split(x, PARTS, axis=1)


def _refined(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks (part, entry, component) after a round of assignment and means."""
    parts, entries, width = books.shape
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Codebook(b) for b in shared.value]
        sums, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)

        def told() -> pa.RecordBatch:
            used = np.flatnonzero(counts)
            return pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))], names=["entry", "n", "total"])

        held = 0
        for b in batches:
            _, able, starts, values = read_vectors(b.column(0))
            x = gathered(np.flatnonzero(able == parts * width), parts * width, starts, values)
            for k, (book, part) in enumerate(zip(found, _parts(x), strict=True)):
                at = book.nearest(part)[0] + k * entries
                np.add.at(sums, at, part)
                counts += np.bincount(at, minlength=len(counts))
            held += len(x)
            if held > 1 << 16:  # sums of that many components are exact
                yield told()
                sums[:], counts[:], held = 0, 0, 0
        yield told()

    each = rows.select("embedding").mapInArrow(run, "entry long, n long, total array<long>")
    wide = each.select("entry", "n", F.posexplode("total").alias("at", "value"))
    added = wide.groupBy("entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    out = books.copy()
    for r in added.collect():  # one row for each number of the codebooks
        out[r["entry"] // entries, r["entry"] % entries, r["at"]] = int(r["value"]) // r["n"]
    return out


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def first_vectors(rows: DataFrame, entries: int = ENTRIES) -> np.ndarray:
    """The integer vectors of the smallest vec_ids, ascending; equal ids by their vectors, null ids last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, able, starts, values = read_vectors(b.column("embedding"))
            ids = b.column("vec_id").cast(pa.int64())
            rank = ids.fill_null(np.iinfo(np.int64).max).to_numpy()
            for dim in np.unique(able[able > 0]).tolist():
                at = np.flatnonzero(able == dim)
                at = at[rank[at] <= np.sort(rank[at])[: entries][-1]]  # no other row of the batch can be among the first
                x = gathered(at, dim, starts, values)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(x.tolist(), pa.list_(pa.int64())), pa.array(np.full(len(at), dim, np.int32))], names=["vec_id", "x", "dim"])

    whole = rows.mapInArrow(run, "vec_id long, x array<long>, dim int")
    order = [F.asc_nulls_last("vec_id"), F.asc("x")]
    first = whole.orderBy(*order).limit(1).collect()
    if not first:
        return np.zeros((0, PARTS), np.int64)
    dim = first[0]["dim"]
    return np.array([r["x"] for r in whole.where(F.col("dim") == dim).orderBy(*order).limit(entries).collect()], np.int64)


def encode(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error) of each kept row of vectors (vec_id, embedding, label), codebooks).

    Rows whose embedding is null or holds null or non-finite components are dropped. All codes are of one length, that of the
    smallest vec_id's vector; a row whose embedding has another one, has none that PARTS divides, or holds components of
    `limit` or more after scaling, stays with null code and error and takes no part in the codebooks. Repeated rows and ids
    count each. With fewer rows than ENTRIES codebooks are as short. Other columns aren't read; an empty table gives no rows.
    """
    rows = own_columns(vectors, "vec_id", "embedding", "label")
    start = first_vectors(rows.select("vec_id", "embedding"))
    books = np.stack(_parts(start)) if len(start) else np.zeros((PARTS, 0, 1), np.int64)
    for _ in range(rounds if len(start) else 0):
        books = _refined(rows, books)
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = shared.value.shape
        found = [Codebook(b) for b in shared.value] if entries else []
        for b in batches:
            kept, able, starts, values = read_vectors(b.column("embedding"))
            at = np.flatnonzero(able == parts * width) if entries else np.zeros(0, np.int64)
            x = gathered(at, parts * width, starts, values)
            codes, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for k, (book, part) in enumerate(zip(found, _parts(x), strict=False)):
                codes[:, k], far = book.nearest(part)
                error += far
            texts, errors = np.full(len(kept), None, object), np.full(len(kept), None, object)
            texts[at], errors[at] = [c.tobytes().hex() for c in codes], error.tolist()
            kept = np.flatnonzero(kept)
            part = b.take(pa.array(kept))
            yield pa.RecordBatch.from_arrays([part.column("vec_id").cast(pa.int64()), part.column("label").cast(pa.int64()), pa.array(texts[kept], pa.string()), pa.array(errors[kept], pa.int64())], names=["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, "vec_id long, label long, code string, error long"), books


def codes_by_label(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of the rows that encode() keeps; label_error adds up the errors
    of equal labels, null ones together, and is null where none of them has an error."""
    coded, books = encode(vectors)
    bare = F.col("label").isNull()
    coded = stash(coded.select("vec_id", bare.alias("bare"), F.coalesce("label", F.lit(0)).alias("label"), "code", "error"), "codes")
    totals = coded.groupBy("bare", "label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
    return joined_evenly(coded, totals, ["bare", "label"]).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    steps, book = [], "b0"
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS (SELECT id, p, x, min(row(d, entry)) AS best FROM (SELECT v.id, v.p, v.x, e.entry, list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - e.x[i]) * (v.x[i] - e.x[i])))::BIGINT AS d FROM v JOIN {book} e ON e.p = v.p) GROUP BY ALL)""")
        if k < rounds:
            steps.append(f"""u{k} AS (SELECT p, entry, list(m ORDER BY i) AS x FROM (SELECT p, struct_extract(best, 2) AS entry, i, floor(sum(x[i]) / count(*))::BIGINT AS m FROM a{k}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM v) + 1)) AS i) GROUP BY ALL) GROUP BY ALL)""")
            steps.append(f"b{k + 1} AS (SELECT {book}.p, {book}.entry, coalesce(u{k}.x, {book}.x) AS x FROM {book} LEFT JOIN u{k} USING (p, entry))")
            book = f"b{k + 1}"
    return f"""WITH w AS (SELECT vec_id, label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x, row_number() OVER (ORDER BY vec_id) - 1 AS id FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
v AS (SELECT id, p, x[p * len(x) // {parts} + 1 : (p + 1) * len(x) // {parts}] AS x FROM w, (SELECT unnest(range({parts})) AS p)),
b0 AS (SELECT p, id AS entry, x FROM v WHERE id < {entries}),
{", ".join(steps)},
c AS (SELECT id, string_agg(printf('%02x', struct_extract(best, 2)), '' ORDER BY p) AS code, sum(struct_extract(best, 1))::BIGINT AS error FROM a{rounds} GROUP BY id),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, entry)) AS codebooks_sha256 FROM {book})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM w JOIN c USING (id), h"""


#: The query in DuckDB SQL, for vectors of one length; every part meets every entry.
ORACLE = _oracle()
