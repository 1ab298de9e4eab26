"""Benchmark passages in training documents, by way of a positional inverted index.

Windows of consecutive benchmark words are phrases to be found. Of each phrase's terms the rarest in the training texts
are looked up; the index holds, for each such term and document, the term's positions. Positions less the term's offset
in the phrase are possible starts of the phrase, and a start on the lists of all looked-up terms is a candidate. Candidates
are verified on the documents' words.

The benchmark is the query set. It is taken in blocks of bounded size, whose vocabulary is broadcast to the tasks that
read documents; what is joined with the index are the postings of the rarest terms alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import as_bytes, boxed, chunks, mix, own_columns, ragged, remembered, sieve, sift, slices, spans, spots, stash, unboxed
from tracewell.llm.shingles import hashes

#: Bytes of benchmark text in a block of queries.
BLOCK_BYTES = 16 << 20
#: Terms of each phrase that are looked up.
LISTS = 2

_KEPT = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _KEPT else 0x20 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased, then runs of digits, a-z and whatever isn't ASCII."""
    return text.translate(_TABLE).split() if text else []


def phrase_hash(h: np.ndarray) -> np.ndarray:
    """A hash of each row of word hashes."""
    out = np.full(len(h), h.shape[1], dtype=np.uint64)
    for k in range(h.shape[1]):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[:, k])
    return out


def phrases(items: DataFrame, window: int) -> DataFrame:
    """(phrase, n, items, terms) for each different window of items (item_id, text): all `window` consecutive words, or
    all of an item's words if they are fewer. Items without words or id have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for item, text in zip(b.column("item_id").to_pylist(), as_bytes(b.column("text")), strict=True):
                w = words(text)
                if not w or item is None:
                    continue
                n = min(window, len(w))
                each = np.lib.stride_tricks.sliding_window_view(hashes(w), n)
                rows += [(int(p), n, item, [x.decode("utf-8", "replace") for x in w[k : k + n]]) for k, p in enumerate(phrase_hash(each).view(np.int64))]
            yield pa.RecordBatch.from_pydict(
                {"phrase": [r[0] for r in rows], "n": pa.array([r[1] for r in rows], pa.int32()), "item_id": pa.array([r[2] for r in rows], pa.int64()), "terms": pa.array([r[3] for r in rows], pa.list_(pa.string()))}
                | ({} if rows else {"phrase": pa.array([], pa.int64())})
            )

    made = items.select("item_id", "text").mapInArrow(run, "phrase long, n int, item_id long, terms array<string>")
    return made.groupBy("phrase").agg(F.first("n").alias("n"), F.sort_array(F.collect_set("item_id")).alias("items"), F.first("terms").alias("terms"))


def _numbered(vocabulary: list[str]) -> dict[bytes, int]:
    return {w.encode(): k for k, w in enumerate(vocabulary)}


def term_counts(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(term, count) in docs for the terms of a bounded vocabulary that occur."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _numbered(shared.value)
        sums = np.zeros(len(number) + 1, dtype=np.int64)
        remembered(None)
        for b in chain.from_iterable(map(slices, batches)):
            for _, texts in chunks([None] * b.num_rows, as_bytes(b.column("text"))):
                w = list(chain.from_iterable(map(words, texts)))
                sums += np.bincount(np.fromiter(map(number.get, w, repeat(len(number))), dtype=np.int64, count=len(w)), minlength=len(sums))
        used = np.flatnonzero(sums[:-1])
        yield pa.RecordBatch.from_arrays([pa.array([shared.value[k] for k in used], pa.string()), pa.array(sums[used])], names=["term", "n"])

    return docs.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("count"))


def build_index(docs: DataFrame, vocabulary: list[str] | None = None) -> DataFrame:
    """Postings (term, doc_id, positions) of docs (doc_id, text), of all terms or of a bounded vocabulary.

    Positions count the document's words from 0 and ascend. A null or empty text has none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = None if shared.value is None else _numbered(shared.value)
        remembered(None)
        for b in chain.from_iterable(map(slices, batches)):
            for ids, texts in chunks(b.column("doc_id").to_pylist(), as_bytes(b.column("text"))):
                split = [words(t) for t in texts]
                w, sizes = list(chain.from_iterable(split)), [len(x) for x in split]
                if number is None:
                    own = {x: k for k, x in enumerate(dict.fromkeys(w))}
                    names = [x.decode("utf-8", "replace") for x in own]
                    term = np.fromiter(map(own.__getitem__, w), dtype=np.int64, count=len(w))
                else:
                    names = shared.value
                    term = np.fromiter(map(number.get, w, repeat(-1)), dtype=np.int64, count=len(w))
                doc, place = np.repeat(np.arange(len(ids)), sizes), spans(sizes)
                at = np.flatnonzero(term >= 0)
                at = at[np.lexsort((at, term[at], doc[at]))]
                key = doc[at] * (len(names) + 1) + term[at]
                heads = np.flatnonzero(np.diff(key, prepend=-1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[k] for k in term[at[heads]]], pa.string()), pa.array([ids[k] for k in doc[at[heads]]], pa.int64()), ragged(place[at].astype(np.int32), np.diff(heads, append=len(at)))],
                    names=["term", "doc_id", "positions"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "term string, doc_id long, positions array<int>")


def candidates(docs: DataFrame, wanted: DataFrame, lists: int = LISTS) -> DataFrame:
    """(doc_id, phrase, n, items, starts): where all looked-up terms of a phrase stand at their offsets."""
    vocabulary = [r[0] for r in wanted.select(F.explode("terms")).distinct().collect()]  # of a block of queries
    counts = term_counts(docs, vocabulary)
    # counts has no more rows than the vocabulary, which the tasks have had already.
    spread = wanted.select("phrase", F.posexplode("terms").alias("offset", "term")).join(F.broadcast(counts), "term", "left")
    rank = Window.partitionBy("phrase").orderBy(F.coalesce("count", F.lit(0)), "offset")
    chosen = spread.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= lists)
    possible = chosen.groupBy("phrase").agg(F.min(F.coalesce("count", F.lit(0))).alias("least"), F.count("*").alias("lists")).where("least > 0")
    chosen = stash(chosen.join(possible, "phrase").select("phrase", "term", "offset", "lists"), "lookups")
    index = stash(build_index(docs, [r[0] for r in chosen.select("term").distinct().collect()]), "postings")
    starts = index.join(chosen, "term").select("phrase", "lists", "doc_id", F.explode("positions").alias("at"), "offset").withColumn("start", F.col("at") - F.col("offset")).where("start >= 0")
    # A document's id may be null or repeated; verification settles what a row really holds.
    met = starts.groupBy("phrase", "doc_id", "start").agg(F.count("*").alias("met"), F.first("lists").alias("lists")).where("met >= lists")
    found = met.groupBy("phrase", "doc_id").agg(F.collect_list("start").alias("starts"))  # of one document
    return found.join(wanted.select("phrase", "n", "items"), "phrase")


RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<long>, hit_spans array<struct<start:int,end:int>>, pick long"

NAMES = [c.split()[0] for c in RESULT.split(", ")]
TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.int64()]


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 13, percent: int = 5) -> DataFrame:
    """Per row of docs (doc_id, text): n_words, n_hit, n_items, items_sha256, contaminated, items, hit_spans.

    A word is hit inside any occurrence of a window of `items` (item_id, text). A document is contaminated when it has a
    hit word and 100 * n_hit >= percent * n_words. Null and empty texts have no words and no hits; items with null text
    or id have no windows; repeated items count once. Rows with the same doc_id are judged each on its own text; a row
    with a null doc_id, too. Other columns aren't read. Without items nothing is hit; an empty table gives no rows.
    """
    own = own_columns(docs, "doc_id", "text").withColumn("pick", F.lit(0).cast("long"))
    return _judged(own, items, window, percent).drop("pick")


def keep_clean(docs: DataFrame, items: DataFrame, window: int = 13, percent: int = 5) -> DataFrame:
    """The rows of docs, all columns, that aren't contaminated."""
    held = stash(boxed(docs), "docs")
    judged = _judged(held.select(F.col("rest.doc_id").alias("doc_id"), F.col("rest.text").alias("text"), F.col("row").alias("pick")), items, window, percent)
    return held.join(judged.where("not contaminated").select(F.col("pick").alias("row")), "row", "left_semi").select(*map(unboxed, docs.columns))


def _judged(docs: DataFrame, items: DataFrame, window: int, percent: int) -> DataFrame:
    """docs: (doc_id, text, pick); pick goes with the row."""
    items = own_columns(items, "item_id", "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    found = None
    for k in range(blocks):
        part = stash(phrases(items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k), window), "phrases")
        one = candidates(docs, part)
        found = one if found is None else found.unionByName(one)
    per_doc = stash(found.groupBy("doc_id").agg(F.collect_list(F.struct("starts", "n", "phrase", "items")).alias("found")), "found")
    # Only documents that may have candidates meet those in a join; the others are judged where they are read.
    bits = docs.sparkSession.sparkContext.broadcast(sieve(per_doc.select("doc_id")))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Judged rows, and with their texts those that can't be judged yet."""
        for b in chain.from_iterable(map(slices, batches)):
            for judged in run(sift(iter([b]), bits.value, inside=False)):
                yield pa.RecordBatch.from_arrays([*judged.columns, pa.nulls(judged.num_rows, pa.string()), pa.array([False] * judged.num_rows, pa.bool_())], names=[*judged.schema.names, "text", "open"])
            for left in sift(iter([b]), bits.value):
                none = {n: pa.nulls(left.num_rows, t) for n, t in zip(NAMES, TYPES, strict=True)}
                yield pa.RecordBatch.from_pydict(none | {"doc_id": left.column("doc_id"), "pick": left.column("pick"), "text": left.column("text").cast(pa.string()), "open": pa.array([True] * left.num_rows, pa.bool_())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered(None)
        for b in chain.from_iterable(map(slices, batches)):
            out = []
            for doc_id, text, hits, pick in zip(b.column("doc_id").to_pylist(), as_bytes(b.column("text")), b.column("found").to_pylist() if "found" in b.schema.names else [None] * b.num_rows, b.column("pick").to_pylist(), strict=True):
                w = words(text)
                hit, met = np.zeros(len(w) + 1, dtype=np.int64), set()
                if hits:
                    h = hashes(w)
                    for n in {x["n"] for x in hits}:
                        own = [x for x in hits if x["n"] == n]
                        at, of = np.concatenate([x["starts"] for x in own]), np.repeat(np.arange(len(own)), [len(x["starts"]) for x in own])
                        fits = at + n <= len(w)
                        at, of = at[fits], of[fits]
                        if not len(at):
                            continue
                        same = phrase_hash(h[at[:, None] + np.arange(n)]).view(np.int64) == np.array([x["phrase"] for x in own])[of]
                        np.add.at(hit, at[same], 1)
                        np.add.at(hit, at[same] + n, -1)
                        for k in np.unique(of[same]):
                            met.update(own[k]["items"])
                covered = np.cumsum(hit)[:-1] > 0 if len(w) else np.zeros(0, bool)
                n_hit = int(covered.sum())
                edge = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0)).tolist()
                said = ",".join(sorted(map(str, met)))
                out.append((doc_id, len(w), n_hit, len(met), hashlib.sha256(said.encode()).hexdigest(), n_hit > 0 and 100 * n_hit >= percent * len(w), sorted(met), [{"start": s, "end": e} for s, e in zip(edge[::2], edge[1::2], strict=True)], pick))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(TYPES)], names=NAMES)

    # Written down, as else a task would have workers for both steps.
    passed = stash(docs.select("doc_id", "text", "pick", *spots("doc_id")).mapInArrow(first, RESULT + ", text string, open boolean"), "judged")
    joined = passed.where("open").select("doc_id", "text", "pick").join(per_doc.withColumnRenamed("doc_id", "found_id"), F.col("doc_id").eqNullSafe(F.col("found_id")), "left")
    return joined.select("doc_id", "text", "found", "pick").mapInArrow(run, RESULT).unionByName(passed.where("not open").drop("text", "open"))


def near_matches(docs: DataFrame, queries: DataFrame, within: int) -> DataFrame:
    """(query_id, doc_id, start, end): shortest runs of at most `within` words with all terms of a query (query_id, text).

    A term that a query repeats counts once. Queries without words match nothing. For each query and document the
    postings of the query's terms meet in one task; these are the document's own words.
    """
    low = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = F.array_distinct(F.regexp_extract_all(low, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0)))
    wanted = queries.select("query_id", terms.alias("terms")).where("size(terms) > 0")
    vocabulary = [r[0] for r in wanted.select(F.explode("terms")).distinct().collect()]  # the stated queries' terms
    index = build_index(docs, vocabulary)
    lists = index.join(wanted.select("query_id", F.size("terms").alias("need"), F.explode("terms").alias("term")), "term")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        need, out = int(pdf["need"].iat[0]), []
        if pdf["term"].nunique() == need:
            at = np.concatenate(pdf["positions"].tolist())
            term = np.repeat(np.unique(pdf["term"], return_inverse=True)[1], [len(p) for p in pdf["positions"]])
            order = np.argsort(at, kind="stable")
            last = np.full(need, -1)
            runs: list[tuple[int, int]] = []
            for p, t in zip(at[order], term[order], strict=True):
                last[t] = p
                start = int(last.min())
                if start >= 0 and p - start < within:
                    if runs and runs[-1][0] == start:
                        continue  # the earlier run with this start is shorter
                    runs.append((start, int(p) + 1))
            out = [r for k, r in enumerate(runs) if k + 1 == len(runs) or not (runs[k + 1][0] >= r[0] and runs[k + 1][1] <= r[1])]
        return pd.DataFrame({"query_id": pdf["query_id"].iat[0], "doc_id": pdf["doc_id"].iat[0], "start": [a for a, _ in out], "end": [b for _, b in out]})

    return lists.groupBy("query_id", "doc_id").applyInPandas(run, "query_id long, doc_id long, start int, end int")


#: The query in DuckDB SQL; the benchmark's windows meet all windows of documents.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
q AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS p FROM (SELECT item_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM (SELECT *, least(13, len(w)) AS n FROM i) WHERE n > 0)),
a AS (SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS p FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d, (SELECT DISTINCT n FROM q) WHERE len(w) >= n)),
h AS (SELECT a.r, a.k, a.n, q.item_id FROM a JOIN q USING (n, p)),
c AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(generate_series(k, k + n - 1)) AS j FROM (SELECT DISTINCT r, k, n FROM h)) GROUP BY r),
m AS (SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT r, item_id FROM h) GROUP BY r)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN m USING (r)
"""
