"""What the operators of this subpackage share: scratch tables in the shared folder, text passes in tasks, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import itertools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

#: Bytes of text that a task holds in arrays at once; a longer single text is taken alone.
CHUNK_BYTES = 1 << 20
#: Bits of a sieve: 4 MB.
SIEVE = 1 << 25
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_serial = itertools.count()
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of this session for scratch tables, below the one that the cluster names in spark.checkpoint.dir.

    Only where that setting is absent and all runs on this machine (tests, a laptop) a temporary folder is made and set.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _own_dirs.get(sc.applicationId)
        if base is None:
            base = _own_dirs[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="tracewell-")
            sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tracewell-{sc.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{next(_serial)}-{uuid.uuid4().hex[:8]}"


_tables: list[DataFrame] = []


def scratch_tables() -> list[DataFrame]:
    """Scratch tables that are still there, oldest first."""
    return list(_tables)


@contextlib.contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries that run within go when those end, not when the driver next collects garbage."""
    was = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, was)


def stash(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """df written to a scratch table and read again: lineage is cut, and lost executors cost one task's work."""
    path = scratch_path(df.sparkSession, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    with shuffles_deleted(df.sparkSession):
        # Small row groups: a task that writes long texts holds one in memory.
        writer.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path  # for drop()
    _tables.append(out)
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes scratch tables that no later step reads."""
    for df in tables:
        _tables[:] = [t for t in _tables if t is not df]
        sc = df.sparkSession.sparkContext
        if sc._jsc is None:  # of a session that has ended
            continue
        path = sc._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that columns of the caller with clashing names can't get in the way."""
    return df.select(*[F.col(f"`{n}`") for n in names])


_memory: dict = {}


def trim() -> None:
    """Gives memory that this process has freed back to the system, where the C library can; workers live for many tasks."""
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release is not None:
        release(0)


def remembered(kind: object, make: Callable[[], object] | None = None) -> object:
    """What this Python worker remembers from task to task of one kind, made on first use.

    Only the last kind asked for is kept, so that workers that serve several operators don't hold what earlier ones knew.
    Without `make`, all is forgotten.
    """
    if kind not in _memory:
        _memory.clear()
        pa.default_memory_pool().release_unused()
        trim()
        if make is not None:
            _memory[kind] = make()
    return _memory.get(kind)


def slices(b: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    """A batch in smaller ones, so that what is made of its texts stays small."""
    for k in range(0, b.num_rows, rows):
        yield b.slice(k, rows)


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def chunks(ids: list, texts: list[bytes | None], most: int = CHUNK_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """Runs of documents of about `most` bytes; null texts come as empty ones."""
    a, b, size = [], [], 0
    for i, t in zip(ids, texts, strict=True):
        t = t or b""
        if a and size + len(t) > most:
            yield a, b
            a, b, size = [], [], 0
        a.append(i)
        b.append(t)
        size += len(t)
    if a:
        yield a, b


def compressed(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The columns `names` of batches, and the text's bytes compressed in z (null: of none)."""
    squeeze = zstandard.ZstdCompressor(level=1)
    for b in itertools.chain.from_iterable(map(slices, batches)):
        z = pa.array([squeeze.compress(t or b"") for t in as_bytes(b.column("text"))], pa.binary())
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), z], names=[*names, "z"])


def squeezed(docs: DataFrame, *keep: str) -> DataFrame:
    """docs with the text's bytes compressed in z (null: of none), doc_id, and the long columns `keep`: less to shuffle."""
    names = [*keep, "doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from compressed(batches, names)

    return docs.select(*names, "text").mapInArrow(run, ", ".join(f"{c} long" for c in names) + ", z binary")


def unsqueezed(column: pa.Array) -> list[bytes]:
    wide = zstandard.ZstdDecompressor()
    return [b"" if z is None else wide.decompress(z) for z in column.to_pylist()]


def boxed(docs: DataFrame, *apart: str) -> DataFrame:
    """(row, rest): a number for each row, and its columns but `apart` in a struct, where their names clash with nothing.

    The numbers hold only once they are written down.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in apart] or [F.lit(None).cast("string").alias("none")]
    return docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*rest).alias("rest"), *[F.col(f"`{c}`") for c in apart])


def unboxed(name: str) -> Column:
    return F.col("rest").getField(name).alias(name)


def with_squeezed(docs: DataFrame) -> DataFrame:
    """docs with z for text, null where that is; all other columns stay."""
    others = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for b in itertools.chain.from_iterable(map(slices, batches)):
            z = pa.array([None if t is None else squeeze.compress(t) for t in as_bytes(b.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in others), z], names=[*others, "z"])

    return docs.mapInArrow(run, StructType([*(docs.schema[c] for c in others), StructField("z", BinaryType())]))


def spots(column: str) -> list[Column]:
    """h1 and h2: an id's places in a sieve."""
    return [F.pmod(F.xxhash64(column, F.lit(k)), F.lit(SIEVE)).alias(f"h{k}") for k in (1, 2)]


def sieve(ids: DataFrame) -> np.ndarray:
    """Bits, SIEVE of them whatever the table's size, of which each of ids (doc_id) has set two."""
    bits = ids.select(F.explode(F.array(*spots("doc_id"))).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("b"))
    out = np.zeros(SIEVE // 64, np.int64)
    found = words.toPandas()  # at most SIEVE / 64 rows
    out[found["w"].to_numpy(np.int64)] = found["b"].to_numpy(np.int64)
    return out.view(np.uint8)


def sift(batches: Iterator[pa.RecordBatch], bits: np.ndarray, inside: bool = True) -> Iterator[pa.RecordBatch]:
    """Of rows with h1 and h2 those that may be among the sieve's ids: all that are, and few others while it isn't full.

    Without `inside` it is the other rows.
    """
    for b in batches:
        keep = np.ones(b.num_rows, bool)
        for c in ("h1", "h2"):
            at = b.column(c).to_numpy()
            keep &= bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1
        yield b.filter(pa.array(keep == inside))


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=schema.field(n).type) for n, c in columns.items()], schema=schema)


def ragged(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A list column: row k has the next lengths[k] of values."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values))


def blobs(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary column: row k has the bytes of the next lengths[k] of values."""
    width = values.dtype.itemsize
    offsets = np.concatenate([[0], np.cumsum(np.asarray(lengths, dtype=np.int64) * width)])
    if offsets[-1] < 1 << 31:
        data = np.ascontiguousarray(values)
        return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
    ends = np.cumsum(lengths)
    return pa.array([values[e - n : e].tobytes() for e, n in zip(ends, lengths, strict=True)], type=pa.binary())


GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def spans(lengths: np.ndarray) -> np.ndarray:
    """0 .. n-1 for each n of lengths, one after the other."""
    lengths = np.asarray(lengths, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Runs of rows with equal keys, from batches sorted by them; a run must fit in memory."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        table = pa.Table.from_batches([*held, b]).combine_chunks().to_batches()[0]
        cols = [table.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        edges = [0, *cuts.tolist()]
        for s, e in zip(edges, edges[1:], strict=False):
            yield table.slice(s, e - s)
        held = [table.slice(edges[-1])]
    yield from held


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number reachable from each of 0 .. n-1 by links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component): for each id of the links (a, b) the smallest id it reaches.

    Alternates large-star and small-star steps, which are groupings with a minimum and one join each: no group is
    gathered, and a hub's rows are reduced before the shuffle. Each round is written to a scratch table; rounds grow
    with the logarithm of the longest chain. Self links and repeated links are allowed.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    linked = both.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    cur, before = stash(linked, name), None
    while True:
        sym = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: from each u, its smaller neighbours and itself go to the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        nxt = stash(small, name)
        seen = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.count_if(F.lit(True))).first()[:2]
        drop(cur)
        cur = nxt
        if seen == before or not seen[0]:
            break
        before = seen
    return cur.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(cur.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def joined_on(found: DataFrame, edges: DataFrame, name: str = "components") -> DataFrame:
    """The components (id, component) of what `found` joins already and of more links (a, b), from those links alone."""
    at = found.select("id", "component")
    ends = edges.join(at.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left").join(at.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
    top = components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), name).select("id", F.col("component").alias("top"))
    moved = at.join(top.withColumnRenamed("id", "component"), "component", "left").select("id", F.coalesce("top", "component").alias("component"))
    return moved.unionByName(top.join(at.select("id"), "id", "left_anti").select("id", F.col("top").alias("component")))


def joined_evenly(rows: DataFrame, facts: DataFrame, keys: list[str], most: int = 1000) -> DataFrame:
    """rows (a written table) inner joined with facts, which have one row a key, so that no key fills a task.

    Keys with more than one in `most` of the rows, of which there can't be `most`, are broadcast with their facts; all
    others meet in a shuffle. Keys mustn't be null.
    """
    n = rows.count()
    often = rows.groupBy(*keys).count().where(F.col("count") * most > n).select(*keys)
    hot = stash(facts.join(F.broadcast(often), keys, "left_semi"), "hot")
    some = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(facts, keys)
    return some.unionByName(rest)


def crc32_text(c: Column) -> Column:
    """crc32 of an id written as text, as the contracts' splits use it (null: null)."""
    return F.crc32(c.cast("string").cast("binary"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer's file lies; TRACEWELL_TOKENIZERS may name another folder."""
    if folder := os.environ.get("TRACEWELL_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
