"""Toxicity of texts by their nearest labelled examples.

Examples are a bounded sample of labelled documents. Terms are words and the beginnings of longer ones; those that toxic
examples hold more often than chance would have it (by the log-likelihood ratio) make the vocabulary. Examples and documents
are TF-IDF vectors over it, with document frequencies counted over the whole corpus; all other words are one term more, which
every document has, so that a vector says how dense the others are.

The index has for each term the weights of the examples in blocks, and each block's greatest one. Of a document's terms those
bound its cosine with any example of a block: blocks are taken by falling bounds until no block left can hold one of the
nearest, so neighbours are exact. They vote with weights that fall with distance. The votes of the examples themselves,
each without its own, calibrate scores by isotonic regression, at the rate at which labels are toxic.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import as_bytes, crc32_text, mix, own_columns, remembered, spans, stash

#: Labelled documents of either side that are examples, at most.
TOXIC, CLEAN = 3000, 6000
#: Log-likelihood ratio from which a term belongs to the vocabulary, and examples that must have it.
EVIDENCE, HOLDERS = 20.0, 3
NEIGHBOURS, BLOCK = 15, 64
#: Characters of beginnings that are terms.
BEGINNINGS = (4, 5, 6)
#: What keeps the weight of a neighbour at cosine 1 finite.
CLOSE = 0.05
REMEMBERED = 400_000

#: Small letters for A-Z; what is neither a letter nor part of another script becomes a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def terms_of(word: bytes) -> list[str]:
    """A word, and its beginnings with a star."""
    w = word.decode("utf-8", "replace")
    return [w, *(w[:n] + "*" for n in BEGINNINGS if len(w) > n)]


class Vocabulary(dict):
    """Places of the terms of a word in a vocabulary, found once for each word; other words share the place behind them."""

    def __init__(self, terms: list[str]):
        super().__init__()
        self.at = {t: k for k, t in enumerate(terms)}
        self.rest = (len(terms),)

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        found = tuple(self.at[t] for t in terms_of(word) if t in self.at) or self.rest
        self[word] = found
        return found

    def counts(self, text: bytes) -> Counter:
        """How often each term occurs; nothing if none is of the vocabulary."""
        if len(self) > REMEMBERED:
            self.clear()
        found = Counter(map(self.__getitem__, words(text)))
        if not found.keys() - {self.rest}:
            return Counter()
        out: Counter = Counter()
        for places, n in found.items():
            for k in places:
                out[k] += n
        return out


def weights(counts: Counter, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(terms, weights): a vector of length 1, ascending by term; empty without terms."""
    at = np.array(sorted(counts), np.int64)
    w = np.array([1 + math.log(counts[k]) for k in at.tolist()]) * idf[at]
    return at, w / np.sqrt((w * w).sum()) if len(w) else w


class Index:
    """Blocks of examples that bound their cosines."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, ids: np.ndarray, n_terms: int):
        # Examples whose heaviest terms are the same share blocks.
        heavy = [(at[np.lexsort((at, -w))].tolist(), int(i)) for (at, w), i in zip(vectors, ids, strict=True)]
        order = sorted(range(len(vectors)), key=heavy.__getitem__)
        self.labels, self.ids = labels[order], ids[order]
        self.n, self.blocks = len(order), -(-len(order) // BLOCK)
        postings: list[list] = [[] for _ in range(n_terms)]
        for place, k in enumerate(order):
            for t, w in zip(*(x.tolist() for x in vectors[k]), strict=True):
                postings[t].append((place, w))
        self.places = np.array([p for x in postings for p, _ in x], np.int64)
        self.weight = np.array([w for x in postings for _, w in x], float)
        # A term's postings of a block are those from its head to the next one's.
        term = np.repeat(np.arange(n_terms), [len(x) for x in postings])
        slot = term * self.blocks + self.places // BLOCK
        self.head = np.searchsorted(slot, np.arange(n_terms * self.blocks + 1))
        self.most = np.zeros(n_terms * self.blocks)
        np.maximum.at(self.most, slot, self.weight)
        self.most = self.most.reshape(n_terms, self.blocks)

    def cosines(self, at: np.ndarray, w: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Of a vector with the examples of some blocks, in their order."""
        slot = at[:, None] * self.blocks + blocks
        size = self.head[slot + 1] - self.head[slot]
        post = np.repeat(self.head[slot].reshape(-1), size.reshape(-1)) + spans(size.reshape(-1))
        row = np.repeat(np.tile(np.arange(len(blocks)), len(at)), size.reshape(-1))
        return np.bincount(row * BLOCK + self.places[post] % BLOCK, np.repeat(w, size.sum(1)) * self.weight[post], len(blocks) * BLOCK)

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int = NEIGHBOURS, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(places, cosines) of the k nearest examples with a common term, by cosine and then place; `without` one place.

        The blocks with the highest bounds are taken first, more at a time from round to round.
        """
        bound = w @ self.most[at]
        some = np.flatnonzero(bound)
        some = some[np.argsort(-bound[some], kind="stable")]
        places, cosines, kth, begin, step = np.zeros(0, np.int64), np.zeros(0), 0.0, 0, 4
        while begin < len(some):
            taken = some[begin : begin + step]
            taken = taken[bound[taken] >= kth - 1e-9]
            if not len(taken):
                break
            c = self.cosines(at, w, taken)
            p = (taken[:, None] * BLOCK + np.arange(BLOCK)).reshape(-1)
            ok = np.flatnonzero((c > 0) & (c >= kth - 1e-9) & (p != without))
            places, cosines = np.concatenate([places, p[ok]]), np.concatenate([cosines, np.minimum(c[ok], 1.0)])
            best = np.lexsort((places, -cosines))[:k]
            places, cosines = places[best], cosines[best]
            kth = cosines[-1] if len(cosines) == k else 0.0
            begin, step = begin + step, step * 4
        return places, cosines

    def vote(self, places: np.ndarray, cosines: np.ndarray) -> float:
        """The share of toxic neighbours, weighted by nearness."""
        w = cosines / (1 - cosines + CLOSE)
        return float((w * self.labels[places]).sum() / w.sum())


class Scale:
    """Votes to probabilities: isotonic steps over a few groups of votes, joined by lines; and one for texts without neighbours."""

    def __init__(self, votes: list[float | None], labels: np.ndarray, rate: float):
        y = np.asarray(labels, float)
        pos, neg = y.sum(), len(y) - y.sum()
        # A clean example stands for as many labelled documents as its side has, against those of a toxic one.
        weight = np.where(y > 0, rate / max(pos, 1), (1 - rate) / max(neg, 1)) * len(y)
        has = np.array([v is not None for v in votes], bool)
        v = np.array([x for x in votes if x is not None])
        self.without = float(((weight * y)[~has].sum() + rate) / (weight[~has].sum() + 1))
        steps: list[list[float]] = []  # vote x weight, toxic, weight
        for value, label, w in sorted(zip(v.tolist(), y[has].tolist(), weight[has].tolist(), strict=True)):
            steps.append([value * w, label * w, w])
            while len(steps) > 1 and steps[-2][1] / steps[-2][2] >= steps[-1][1] / steps[-1][2]:
                last = steps.pop()
                steps[-1] = [a + b for a, b in zip(steps[-1], last, strict=True)]
        self.x = np.array([s[0] / s[2] for s in steps])
        self.y = np.maximum.accumulate([(s[1] + rate) / (s[2] + 1) for s in steps]) if steps else np.zeros(0)

    def of(self, vote: float | None) -> float:
        if vote is None or not len(self.x):
            return self.without
        return float(np.interp(vote, self.x, self.y))


class Model:
    def __init__(self, terms: list[str], idf: np.ndarray, index: Index | None, scale: Scale | None):
        self.terms, self.idf, self.index, self.scale = terms, idf, index, scale

    def score(self, text: bytes, vocabulary: Vocabulary) -> tuple[float, list[str], list[tuple[int, int, float]]]:
        """(score, terms of the vocabulary, neighbours (doc_id, toxic, cosine)) of a text."""
        if self.index is None:
            return 0.0, [], []
        at, w = weights(vocabulary.counts(text), self.idf)
        if not len(at):
            return self.scale.without, [], []
        places, cosines = self.index.nearest(at, w)
        vote = self.index.vote(places, cosines) if len(places) else None
        near = list(zip(self.index.ids[places].tolist(), self.index.labels[places].tolist(), cosines.tolist(), strict=True))
        return self.scale.of(vote), [self.terms[k] for k in at.tolist() if k < len(self.terms)], near


def _copy_key(w: list[bytes]) -> int:
    """Texts that are nearly equal mostly share it: the least hash of three words in turn."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    if len(h) < 3:
        return xxhash.xxh3_64_intdigest(b" ".join(w)) >> 1
    return int(mix(mix(mix(h[:-2]) + h[1:-1]) + h[2:]).min() >> np.uint64(1))


def _examples(docs: DataFrame, labels: DataFrame, toxic: int, clean: int) -> tuple[DataFrame, float]:
    """((doc_id, toxic, copy, text, terms) of the sample, one of each group of near copies; the share of toxic labels)."""
    marked = own_columns(labels, "doc_id", "toxic").dropna().groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    there = stash(marked.join(own_columns(docs, "doc_id"), "doc_id", "left_semi"), "labelled")
    totals = {r["toxic"]: r["count"] for r in there.groupBy("toxic").count().collect()}
    drawn = F.xxhash64("doc_id", F.lit(12))
    sides = [there.where(F.col("toxic") == side).orderBy(drawn, "doc_id").limit(n) for side, n in ((1, toxic), (0, clean))]
    picked = sides[0].unionByName(sides[1])
    texts = own_columns(docs, "doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, t in enumerate(as_bytes(b.column("text"))):
                w = words(t or b"")
                found = {term for x in set(w) for term in terms_of(x)}
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(k, 1).cast(pa.int64()), b.column("toxic").slice(k, 1), pa.array([_copy_key(w)]), pa.array([t or b""], pa.binary()), pa.array([list(found)], pa.list_(pa.string()))], names=["doc_id", "toxic", "copy", "text", "terms"])

    rows = stash(texts.mapInArrow(run, "doc_id long, toxic int, copy long, text binary, terms array<string>"), "examples")
    first = rows.groupBy("copy", "toxic").agg(F.min("doc_id").alias("doc_id"))
    n = sum(totals.values())
    return rows.join(first.select("doc_id"), "doc_id", "left_semi"), totals.get(1, 0) / n if n else 0.0


def _log_ratio(a: Column, b: Column, pos: float, neg: float) -> Column:
    """The log-likelihood ratio of a of pos toxic examples having a term, and b of neg others, against one common rate."""
    part = lambda x, whole, rate: F.when(x > 0, x * F.ln(x / (whole * rate))).otherwise(0.0)
    share = (a + b) / (pos + neg)
    return 2 * (part(a, pos, share) + part(b, neg, share) + part(pos - a, pos, 1 - share) + part(neg - b, neg, 1 - share))


def _frequencies(docs: DataFrame, terms: list[str]) -> tuple[np.ndarray, int]:
    """In how many documents each term occurs, and how many documents there are."""
    key = ("toxicity terms", xxhash.xxh3_64_hexdigest("\n".join(terms).encode()))
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = remembered(key, lambda: Vocabulary(shared.value))
        seen = np.zeros(len(shared.value) + 2, np.int64)
        for b in batches:
            seen[-1] += b.num_rows
            for t in as_bytes(b.column(0)):
                if t:
                    seen[list(vocabulary.counts(t))] += 1
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], names=["term", "n"])

    out = np.zeros(len(terms) + 2, np.int64)
    for r in docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # one row a term
        out[r["term"]] = r["n"]
    return out[:-2], int(out[-1])


def train(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None, toxic: int = TOXIC, clean: int = CLEAN) -> Model:
    """A model from the labels (doc_id, toxic) of docs (doc_id, text); term frequencies are those of corpus (text), else of docs.

    Labels that are null, or whose doc_id is or isn't in docs, don't count; of several for one document the majority does.
    Rows that share a doc_id give one example, with the first of their texts in order. Without a label there is no example,
    and all scores are 0.
    """
    rows, rate = _examples(docs, labels, toxic, clean)
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not sizes:
        return Model([], np.zeros(0), None, None)
    pos, neg = float(sizes.get(1, 0)), float(sizes.get(0, 0))
    each = rows.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("toxic").cast("double").alias("a"), F.count_if(F.col("toxic") == 0).cast("double").alias("b"))
    chosen = each.where((F.col("a") >= HOLDERS) & (F.col("a") * neg > F.col("b") * pos)).where(_log_ratio(F.col("a"), F.col("b"), pos, neg) >= EVIDENCE)
    terms = sorted(r["term"] for r in chosen.select("term").collect())  # of the sample's terms
    df, n = _frequencies(own_columns(docs if corpus is None else corpus, "text"), terms)
    idf = np.append(np.log((n + 1) / (df + 1)) + 1, 1.0)  # all other words are everywhere
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(shared.value)
        for b in batches:
            found = [vocabulary.counts(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array([list(c) for c in found], pa.list_(pa.int64())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))], names=["doc_id", "toxic", "at", "n"])

    sample = {r["doc_id"]: r for r in rows.select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, at array<long>, n array<long>").collect()}  # at most toxic + clean
    found = {i: Counter(dict(zip(r["at"], r["n"], strict=True))) for i, r in sample.items()}
    ids = np.array(sorted(found), np.int64)
    vectors = [weights(found[i], idf) for i in ids.tolist()]
    y = np.array([sample[i]["toxic"] for i in ids.tolist()], np.int64)
    some = [k for k, (t, _) in enumerate(vectors) if len(t)]
    index = Index([vectors[k] for k in some], y[some], ids[some], len(idf))
    place = {i: p for p, i in enumerate(index.ids.tolist())}
    votes: list[float | None] = []
    for i, (t, w) in zip(ids.tolist(), vectors, strict=True):
        near = index.nearest(t, w, without=place[i]) if len(t) else ((), ())
        votes.append(index.vote(*near) if len(near[0]) else None)
    return Model(terms, idf, index, Scale(votes, y, rate))


def score(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted, terms, neighbours) for each row of docs (doc_id, text).

    score is the probability of a toxic label, in 0 to 1, by the text alone; predicted is 1 from `least` on. A null or empty
    text, and one without a term of the vocabulary, gets the rate of examples without one. Evidence are its terms and the
    nearest examples, by cosine. Rows with the same or no doc_id are scored each. Other columns aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = ("toxicity", xxhash.xxh3_64_hexdigest("\n".join(model.terms).encode()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        vocabulary = remembered(key, lambda: Vocabulary(m.terms))
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())]))
        for b in batches:
            found = [m.score(t or b"", vocabulary) for t in as_bytes(b.column("text"))]
            scores = np.array([s for s, _, _ in found])
            near = pa.array([[{"doc_id": i, "toxic": y, "cosine": c} for i, y, c in n] for _, _, n in found], kind)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(scores), pa.array((scores >= least).astype(np.int32)), pa.array([t for _, t, _ in found], pa.list_(pa.string())), near], names=["doc_id", "score", "predicted", "terms", "neighbours"])

    return own_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int, terms array<string>, neighbours array<struct<doc_id: long, toxic: int, cosine: double>>")


def learned_split(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, terms, neighbours): score() with the labels of rows that aren't held out, those
    with crc32(doc_id) mod 4 other than 2. A null doc_id isn't held out."""
    held_out = F.coalesce(F.pmod(crc32_text(F.col("doc_id")), F.lit(4)) == 2, F.lit(False))
    rows = own_columns(docs, "doc_id", "text")
    model = train(rows.where(~held_out), labels, rows)
    return score(rows, model).select("doc_id", held_out.alias("held_out"), "score", "predicted", "terms", "neighbours")
