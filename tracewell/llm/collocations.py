"""Phrases of words that occur together more often than by chance, for each language.

Texts are exploded into rows of phrases with counts, a length after the other, and counted by hash aggregation for each
language. All words and pairs have rows. A longer phrase that occurs often enough has no part that doesn't, so it has a row
only if it is frequent by its two parts with one word less, which tasks know from a sieve of a fixed size, and if it may be
frequent itself: hashes of those left are counted first, in shards of counters of a fixed size, for which a phrase costs a
few bytes. Sieves and counters let all frequent phrases through, and as they fill more of the others, which the counts then
drop: counts are exact, and so are words, which travel as text.

Candidates meet the counts of their beginnings and ends in joins; scores are exact decimals. A candidate goes if a phrase
with one word more occurs as often; longer ones can't without it. The window that ranks a language's candidates is fed by
the first ones of each task only.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import GOLD, as_bytes, joined_evenly, mix, own_columns, shuffle_width, slices, stash

#: A sieve has SPARE bits for each frequent phrase, up to MOST of them: 16 MB.
SPARE, LEAST, MOST = 16, 1 << 20, 1 << 27
#: Text that a task counts at once.
CHUNK = 2 << 20
#: Rows of phrases in a batch.
ROWS = 20_000
#: Counters of a shard, pairs for which there is one, and shards at most.
COUNTERS, SHARE, SHARDS = 1 << 22, 1 << 21, 1024

_BREAK = b"."
#: Capitals to small letters, and all that ends a piece to the break, which no word can hold.
_TABLE = bytes(ord(_BREAK) if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))


def tokens(texts: list[bytes]) -> list[bytes]:
    """Words of all texts in turn, with breaks where a piece ends."""
    return b" . ".join(texts).translate(_TABLE).replace(_BREAK, b" . ").split()


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Languages with about CHUNK bytes of their texts."""
    held: dict[str, list[bytes]] = {}
    size: Counter = Counter()
    for b in chain.from_iterable(map(slices, batches)):
        for lang, text in zip(b.column("lang").to_pylist(), as_bytes(b.column("text")), strict=True):
            if not text:
                continue
            held.setdefault(lang, []).append(text)
            size[lang] += len(text)
            if size.total() > CHUNK:
                yield from held.items()
                held, size = {}, Counter()
    yield from held.items()


def _rows(lang: str, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), phrases.cast(pa.binary()), pa.array(counts.astype(np.int64))], names=["lang", "phrase", "n"])


_SCHEMA = "lang string, phrase binary, n long"


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def phrase_hashes(start: np.uint64, words: list[np.ndarray]) -> np.ndarray:
    """Names of phrases, whose first, second, ... words' hashes are given; `start` stands for the language."""
    h = mix(words[0] ^ start)
    for w in words[1:]:
        h = mix(h * GOLD + w)
    return h


def language_hash(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (h & np.uint64(bits - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


def sieve_of(names: DataFrame) -> np.ndarray:
    """Bits, of which each of names (name) has set two; at most MOST, however many there are."""
    bits = min(MOST, max(LEAST, 1 << (SPARE * names.count()).bit_length()))

    # In the JVM: names may come from Python, and a task with two such steps would leave two workers in its executor for good.
    name = F.col(names.columns[0])
    bit = F.explode(F.array(*[F.shiftrightunsigned(name, k).bitwiseAND(F.lit(bits - 1)) for k in (0, 32)])).alias("bit")
    words = names.select(bit).groupBy(F.shiftright("bit", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("b"))
    out = np.zeros(bits // 64, np.int64)
    found = words.toPandas()  # at most MOST / 64 rows
    out[found["w"].to_numpy(np.int64)] = found["b"].to_numpy(np.int64)
    return out.view(np.uint8)


def names_of(frequent: DataFrame, length: int) -> DataFrame:
    """(name): the hashes of phrases of `length` words (lang, phrase)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            split = [p.split(b" ") for p in b.column("phrase").to_pylist()]
            start = np.fromiter((language_hash(x) for x in b.column("lang").to_pylist()), np.uint64, b.num_rows)
            h = phrase_hashes(start, [word_hashes([w[k] for w in split]) for k in range(length)])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["name"])

    return frequent.select("lang", "phrase").mapInArrow(run, "name long")


def passes(sieve: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.ones(len(h), bool)
    for at in _places(h, len(sieve) * 8):
        out &= sieve[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1
    return out


def _runs(docs: DataFrame) -> DataFrame:
    """(lang, words, ids): texts as places in a list of words, -1 for breaks; both compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for lang, texts in _by_language(batches):
            # The break comes first, so that it is place 0.
            ids, words = pd.factorize(np.array([_BREAK, *tokens(texts)], dtype=object))
            ids = ids.astype(np.int32) - 1
            ids = ids[(ids >= 0) | np.concatenate([[True], ids[:-1] >= 0])]  # one break for many
            if len(words) > 1:
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([squeeze.compress(b" ".join(words[1:]))], pa.binary()), pa.array([squeeze.compress(ids.view(np.uint8).reshape(-1, 4).T.tobytes())], pa.binary())], names=["lang", "words", "ids"])

    return docs.mapInArrow(run, "lang string, words binary, ids binary")


def _opened(b: pa.RecordBatch, k: int) -> tuple[list[bytes], np.ndarray]:
    """(words, ids) of row k of runs."""
    wide = zstandard.ZstdDecompressor()
    raw = wide.decompress(b.column("ids")[k].as_py())
    return wide.decompress(b.column("words")[k].as_py()).split(b" "), np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view(np.int32).reshape(-1).astype(np.int64)


def _possible(lang: str, words: list[bytes], ids: np.ndarray, length: int, parts: np.ndarray | None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray | None]:
    """(at, places, hashes): for each place the words from it on, the places of phrases without a break and with both parts in
    the sieve (None: all), and those phrases' hashes, if there is a sieve."""
    at = [ids[j : max(0, len(ids) - length + 1) + j] for j in range(length)]
    there = np.flatnonzero(np.all([a >= 0 for a in at], axis=0))
    if parts is None:
        return at, there, None
    hashes, start = word_hashes(words), language_hash(lang)
    for part in (at[:-1], at[1:]):
        there = there[passes(parts, phrase_hashes(start, [hashes[a[there]] for a in part]))]
    return at, there, phrase_hashes(start, [hashes[a[there]] for a in at])


def counter_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Which of all shards' counters counts a phrase; a shard's are neighbours."""
    return ((h >> np.uint64(32)) * np.uint64(shards * COUNTERS)) >> np.uint64(32)


def frequent_counters(runs: DataFrame, length: int, parts: np.ndarray, shards: int, least: int) -> DataFrame:
    """(name) of the counters that count `least` or more of the phrases in runs whose parts pass the sieve."""
    shared = runs.sparkSession.sparkContext.broadcast(parts)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        planes = lambda x: squeeze.compress(x.view(np.uint8).reshape(-1, 4).T.tobytes())
        for b in batches:
            for k in range(b.num_rows):
                _, there, h = _possible(b.column("lang")[k].as_py(), *_opened(b, k), length, shared.value)
                if not len(there):
                    continue
                own, times = np.unique(counter_of(h, shards), return_counts=True)
                shard = (own // np.uint64(COUNTERS)).astype(np.int64)
                heads = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(shard)).tolist()
                low = (own % np.uint64(COUNTERS)).astype(np.uint32)
                rows = [(planes(np.diff(low[i:j], prepend=np.uint32(0))), planes(times[i:j].astype(np.uint32))) for i, j in zip(heads, heads[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(shard[heads[:-1]]), pa.array([x for x, _ in rows], pa.binary()), pa.array([x for _, x in rows], pa.binary())], names=["shard", "at", "times"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = zstandard.ZstdDecompressor()
        plain = lambda z: np.ascontiguousarray(np.frombuffer(wide.decompress(z), np.uint8).reshape(4, -1).T).view(np.uint32).reshape(-1)
        shard, counts = None, np.zeros(0, np.int64)

        def told() -> pa.RecordBatch:
            own = np.flatnonzero(counts >= least).astype(np.uint64) + np.uint64((shard or 0) * COUNTERS)
            return pa.RecordBatch.from_arrays([pa.array(mix(own + GOLD).view(np.int64))], names=["name"])

        for b in batches:
            for s, at, times in zip(*(b.column(c).to_pylist() for c in ("shard", "at", "times")), strict=True):
                if s != shard:
                    if shard is not None:
                        yield told()
                    shard, counts = s, np.zeros(COUNTERS, np.int64)
                counts[np.cumsum(plain(at), dtype=np.int64)] += plain(times)
        yield told()

    each = runs.mapInArrow(dealt, "shard long, at binary, times binary")
    return each.repartition(min(shards, 8 * shuffle_width(runs.sparkSession)), "shard").sortWithinPartitions("shard").mapInArrow(counted, "name long")


def _phrases(runs: DataFrame, length: int, parts: np.ndarray | None = None, counters: np.ndarray | None = None, shards: int = 1) -> DataFrame:
    """Rows of phrases of `length` words (lang, phrase, n): all, or those whose parts and counters pass the sieves."""
    shared = runs.sparkSession.sparkContext.broadcast((parts, counters))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, counters = shared.value
        for b in batches:
            for k in range(b.num_rows):
                lang, (words, ids) = b.column("lang")[k].as_py(), _opened(b, k)
                at, there, h = _possible(lang, words, ids, length, parts)
                if counters is not None:
                    there = there[passes(counters, mix(counter_of(h, shards) + GOLD))]
                if not len(there):
                    continue
                key = at[0][there]
                for a in at[1:]:
                    key = pd.factorize(key * len(words) + a[there])[0]
                n = np.bincount(key)
                first = np.empty(len(n), np.int64)
                first[key[::-1]] = there[::-1]
                names = pa.array(words, pa.binary())
                for begin in range(0, len(n), ROWS):
                    some = first[begin : begin + ROWS]
                    yield _rows(lang, pc.binary_join_element_wise(*[names.take(pa.array(a[some])) for a in at], pa.scalar(b" ", pa.binary())), n[begin : begin + ROWS])

    return runs.mapInArrow(run, _SCHEMA)


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("lang", "phrase").agg(F.sum("n").alias("a"))


def phrases(docs: DataFrame, longest: int = 5, least: int = 100, most: int = 2000, percent: int = 100) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `most` best phrases of 2 to `longest` words of each language in docs (lang, text).

    Capitals A-Z are lowered; `.,;:!?` and line ends divide a text, spaces and tabs its pieces into words. n counts a language's
    words, a the phrase's occurrences, which may overlap; only phrases with `least` of them count. Each way to cut a phrase in
    two, with counts l and r, gives the score floor(1000 * a * n / (l * r)); the lowest counts, of equal ones that of the
    shortest beginning. A phrase that a longer one contains with at least `percent` of its occurrences is dropped. Ranks go by
    score and a, descending, then by the phrase's bytes.

    A null lang is `und`; null and empty texts have no words; repeated rows count each. Other columns aren't read. Without
    frequent phrases there are no rows. Counts may have 15 digits.
    """
    rows = own_columns(docs, "lang", "text").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    runs = stash(_runs(rows), "runs")
    words = stash(_counted(_phrases(runs, 1)), "words")
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    shards = max(1, min(SHARDS, -(-(words.agg(F.sum("a")).first()[0] or 0) // SHARE)))
    counts = [words.where(F.col("a") >= least)]
    for length in range(2, longest + 1):
        parts = counters = None
        if length > 2:
            parts = sieve_of(names_of(counts[-1], length - 1))
            counters = sieve_of(stash(frequent_counters(runs, length, parts, shards, least), "counters"))
        counts.append(stash(_counted(_phrases(runs, length, parts, counters, shards)).where(F.col("a") >= least), "frequent"))
    known, candidates = counts[0], counts[1]
    for c in counts[1:]:
        known = known.unionByName(c)
    for c in counts[2:]:
        candidates = candidates.unionByName(c)
    text = lambda df: df.withColumn("phrase", F.col("phrase").cast("string"))
    known, candidates = text(known), text(candidates).withColumn("words", F.split("phrase", " "))

    # Sizes of all cuts, with the counts of what is before and behind.
    piece = lambda start, size: F.array_join(F.slice("words", start, size), " ")
    cuts = candidates.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = stash(cuts.select("lang", "phrase", "a", "k", piece(F.lit(1), F.col("k")).alias("before"), piece(F.col("k") + 1, F.size("words")).alias("behind")), "cuts")
    met = stash(joined_evenly(cuts, known.select("lang", F.col("phrase").alias("before"), F.col("a").alias("l")), ["lang", "before"]).drop("before"), "cuts")
    met = stash(joined_evenly(met, known.select("lang", F.col("phrase").alias("behind"), F.col("a").alias("r")), ["lang", "behind"]).drop("behind"), "cuts")
    met = joined_evenly(met, totals, ["lang"])
    exact = {c: F.col(c).cast("decimal(15,0)") for c in ("a", "l", "r", "n")}
    scored = met.withColumns({f"{c}_": v for c, v in exact.items()}).withColumn("score", F.expr("(a_ * n_ * 1000BD) div (l_ * r_)"))
    best = scored.groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", "n", "score"), F.struct("score", "k")).alias("x")).select("lang", "phrase", "x.*")

    # One word less at either end of each phrase, with the occurrences from which those are dropped.
    inner = candidates.where(F.size("words") > 2).select("lang", F.col("a").alias("more"), F.explode(F.array(piece(F.lit(1), F.size("words") - 1), piece(F.lit(2), F.size("words") - 1))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("more").alias("more"))
    left = best.join(inner, (best["lang"] == inner["lang"]) & (best["phrase"] == inner["phrase"]) & (inner["more"] * 100 >= best["a"] * percent), "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The query in DuckDB SQL.
ORACLE = r"""
WITH p AS (SELECT row_number() OVER () AS id, lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
g AS (SELECT lang, k, array_to_string(words[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(words) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
t AS (SELECT lang, sum(a)::HUGEINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS words FROM f WHERE k > 1 AND a >= 100),
cut AS (SELECT c.lang, c.phrase, c.a, j, array_to_string(words[1 : j], ' ') AS before, array_to_string(words[j + 1 :], ' ') AS behind FROM c, (SELECT unnest(range(1, 5)) AS j) WHERE j < k),
s AS (SELECT cut.lang, cut.phrase, cut.a, x.a AS l, y.a AS r, n, j, (1000::HUGEINT * cut.a * n) // (x.a::HUGEINT * y.a) AS score FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = before JOIN f y ON y.lang = cut.lang AND y.phrase = behind JOIN t ON t.lang = cut.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
d AS (SELECT lang, array_to_string(words[i : i + m - 1], ' ') AS phrase, max(a) AS a FROM (SELECT lang, words, a, m, unnest(range(1, k - m + 2)) AS i FROM c, (SELECT unnest(range(2, 5)) AS m) WHERE m < k) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM b WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.lang = b.lang AND d.phrase = b.phrase AND 100 * d.a >= 100 * b.a) QUALIFY rank <= 2000"""
