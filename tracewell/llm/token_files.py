"""Token-id files: canonical length-limited Huffman codes from global counts, in blocks that decode on their own.

A data set is a Parquet folder of blocks, split into folders shard=0, 1, ... that hold ascending ranges of doc_id. A
block has consecutive documents:

    block     number within the shard, ascending with doc_id
    doc_ids   ids of the documents; starts: ids of all documents before each; lengths: its own ids
    bits      the codes, most significant bit first, zero bits at the end
    marks     bit offsets of the ids 0, EVERY, 2 * EVERY, ... of the block: places where decoding can begin

and a table `codebook` (id, bits) with the length of each id's code. Codes of one length are consecutive and in the
order of ids, and shorter codes sort first, so lengths alone define them. No code is longer than LIMIT bits; a table of
2^LIMIT entries, indexed by the next LIMIT bits, gives id and length. A block is decoded from all its marks at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import batch, own_columns, ragged, scratch_path, stash
from tracewell.llm.tokens import crc32_ids, tokenize, unpack_ids

#: Most bits of a code; enough for 2^LIMIT different ids.
LIMIT = 20
#: Ids between two marks.
EVERY = 512
#: Ids after which a block ends.
BLOCK = 1 << 18


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal code under `limit` for the ids with counts above 0 (others: 0), by package merge."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids don't fit codes of {limit} bits")
    order = used[np.lexsort((used, counts[used]))]
    leaves = counts[order].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        merged = np.concatenate([leaves, packages])
        by = np.argsort(merged, kind="stable")
        levels.append(by < len(leaves))
        merged = merged[by]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    take = 2 * len(leaves) - 2
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        out[order[:n]] += 1
        take = 2 * (take - n)
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each id with a length above 0."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    code, last = 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    for n in np.unique(lengths[order]):
        ids = order[lengths[order] == n]
        code <<= int(n) - last
        codes[ids] = np.arange(code, code + len(ids), dtype=np.uint64)
        code, last = code + len(ids), int(n)
    return codes


def encode_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The codes of ids in turn, and the bit offset of each EVERY-th."""
    if not len(ids):
        return b"", np.zeros(0, np.int64)
    n = lengths.astype(np.int32)[ids]
    at = np.cumsum(n, dtype=np.int64) - n
    word, shift = (at >> 5).astype(np.int32), (64 - (at & 31) - n).astype(np.uint64)
    value = codes[ids] << shift
    heads = np.flatnonzero(np.diff(word, prepend=-1))
    words = np.zeros(int(word[-1]) + 2, dtype=np.uint64)  # codes don't share bits, so sums are unions
    words[word[heads]] += np.add.reduceat(value >> np.uint64(32), heads)
    words[word[heads] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), heads)
    end = int(at[-1] + n[-1])
    return words.astype(">u4").tobytes()[: (end + 7) // 8], at[::EVERY]


def decode_table(lengths: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Id and length, as id * 256 + length, for each value of the next `limit` bits."""
    out = np.zeros(1 << limit, dtype=np.int64)
    codes = canonical(lengths)
    used = np.flatnonzero(lengths)
    used = used[np.argsort(codes[used] << (np.uint64(limit) - lengths[used].astype(np.uint64)))]
    wide = np.int64(1) << (limit - lengths[used].astype(np.int64))
    out[: wide.sum()] = np.repeat(used << 8 | lengths[used], wide)
    return out


def decode_bits(bits: bytes, marks: np.ndarray, total: int, table: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """`total` ids, from all marks side by side."""
    if not total:
        return np.zeros(0, np.uint32)
    data = np.frombuffer(bits + bytes(8), dtype=np.uint8).astype(np.int64)
    words = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    at = np.asarray(marks, dtype=np.int64).copy()
    out = np.zeros((EVERY, len(at)), dtype=np.uint32)
    mask, last = (1 << limit) - 1, total - EVERY * (len(at) - 1)
    for k in range(EVERY):
        if k == last:  # the last mark has fewer ids
            at = at[:-1]
        if not len(at):
            break
        found = table[(words[at >> 3] >> (32 - limit - (at & 7))) & mask]
        out[k, : len(at)] = found >> 8
        at += found & 255
    return out.T.reshape(-1)[:total]


assert LIMIT + 7 <= 32

BLOCKS = "shard int, block long, doc_ids array<long>, starts array<long>, lengths array<long>, bits binary, marks array<long>"
DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def count_ids(tokens: DataFrame) -> DataFrame:
    """(id, n): how often each id occurs, from the rows that tokenize() ends its tasks with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column("ids").to_pylist():
                n = np.frombuffer(zstandard.decompress(blob), dtype=np.int64)
                used = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used])], names=["id", "n"])

    return tokens.where("n_tokens < 0").select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> None:
    """Writes docs (doc_id, text) as a data set below path.

    Ids are ascending in doc_id; rows with the same doc_id are ordered by their ids' number and crc32, a null doc_id comes
    first, a null text has the end id alone. Other columns aren't read. An empty table gives no blocks.

    Texts are tokenized where they are read and kept once, compressed. Their ids are then dealt by ranges of doc_id.
    What reaches the driver is a count for each id of the vocabulary and a sum for each shard.
    """
    spark = docs.sparkSession
    tokens = stash(tokenize(own_columns(docs, "doc_id", "text"), tokenizer, end_id, counts=True), "ids")
    counts = {r["id"]: r["n"] for r in count_ids(tokens).collect()}
    tokens = tokens.where("n_tokens > 0")
    sums = np.zeros(max(counts, default=0) + 1, dtype=np.int64)
    sums[list(counts)] = list(counts.values())
    lengths = code_lengths(sums)
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id long, bits int").coalesce(1).write.parquet(f"{path}/codebook")

    total = int(sums.sum())
    shards = max(1, -(-total // (16 * BLOCK)), int(spark.conf.get("spark.sql.shuffle.partitions")) if total > 16 * BLOCK else 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = canonical(lengths)
        schema = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("bits", pa.binary()), ("marks", pa.list_(pa.int64()))])
        block, start, held, size = 0, 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal block, start, held, size
            n = [len(x) for _, x in held]
            bits, marks = encode_bits(np.concatenate([x for _, x in held]), codes, lengths)
            made = batch(schema, shard=[shard], block=[block], doc_ids=[[i for i, _ in held]], starts=[(start + np.cumsum(n) - n).tolist()], lengths=[n], bits=[bits], marks=[marks.tolist()])
            block, start, held, size = block + 1, start + sum(n), [], 0
            return made

        shard = 0
        for b in batches:
            for shard, doc_id, blob in zip(*(b.column(c).to_pylist() for c in ("shard", "doc_id", "ids")), strict=True):
                held.append((doc_id, x := unpack_ids(blob)))
                size += len(x)
                if size >= BLOCK:
                    yield flush()
        if held:
            yield flush()

    # salt differs for rows that share all else, so that even those needn't meet in one shard.
    order = ["doc_id", "n_tokens", "ids_crc32", "salt"]
    ordered = tokens.repartitionByRange(shards, *order).sortWithinPartitions(*order).withColumn("shard", F.spark_partition_id())
    ordered.select("shard", "doc_id", "ids").mapInArrow(run, BLOCKS).write.partitionBy("shard").option("compression", "none").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """Per document of a data set: doc_id, start (over all shards), n_tokens, ids_crc32 and, if asked for, ids as array<int>."""
    lengths_of = {r["id"]: r["bits"] for r in spark.read.schema("id long, bits int").parquet(f"{path}/codebook").collect()}
    lengths = np.zeros(max(lengths_of, default=0) + 1, dtype=np.uint8)
    lengths[list(lengths_of)] = list(lengths_of.values())
    blocks = spark.read.schema(BLOCKS.replace("shard int, ", "") + ", shard int").parquet(f"{path}/blocks")
    size = blocks.groupBy("shard").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("n"))
    before, base = 0, {}
    for r in sorted(size.collect()):  # a row for each shard
        base[r["shard"]] = before
        before += r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(lengths)
        for b in batches:
            for shard, doc_ids, starts, sizes, bits, marks in zip(*(b.column(c).to_pylist() for c in ("shard", "doc_ids", "starts", "lengths", "bits", "marks")), strict=True):
                found = decode_bits(bits, np.array(marks), sum(sizes), table)
                parts = np.split(found, np.cumsum(sizes)[:-1])
                columns = [pa.array(doc_ids, pa.int64()), pa.array(np.array(starts, np.int64) + base[shard]), pa.array(sizes, pa.int64()), pa.array([crc32_ids(x) for x in parts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [ragged(found.astype(np.int32), np.array(sizes))] * ids, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + ids])

    return blocks.mapInArrow(run, DOCS + ", ids array<int>" * ids)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1, ids: bool = True) -> DataFrame:
    """What read() gives of files that write() has written into the shared folder."""
    path = scratch_path(docs.sparkSession, "token-files")
    write(docs, path, tokenizer, end_id)
    return read(docs.sparkSession, path, ids)
