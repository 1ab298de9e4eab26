"""A quality classifier from weak labels.

Heuristic labellers look at each document and vote good, junk, or nothing. How often each pattern of votes occurs in the
whole corpus is counted, and expectation-maximisation finds from those counts each labeller's accuracy and the probability of
good for each pattern. Those probabilities are the labels by
which a linear scorer of hashed features is trained on a bounded sample; the scorer then judges every document.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import as_bytes, chunks, own_columns, remembered, spans, stash

#: Documents of each side (good, junk) that the scorer is trained on, at most.
SAMPLE = 2000
#: Hashed features.
WIDTH = 1 << 15
REMEMBERED = 400_000
#: Added to the number of words that features are averaged over: a few words say little.
DAMPING = 4

#: (name, junk from, good up to): a share of the document at or over the first votes junk, at or under the second good.
#: Labellers of one symptom have no second: that it is absent says little.
LABELLERS = (
    ("shouting", 0.30, None),  # words of capitals
    ("exclaiming", 0.20, None),  # words with repeated ! or ?
    ("separators", 0.10, None),  # words that are a lone separator
    ("symbols", 0.10, None),  # words with runs of symbols
    ("stutter", 0.15, None),  # words equal to the one before
    ("lines", 0.40, None),  # repeated lines, of texts with 4 lines or more
    ("repetition", 0.60, 0.40),  # words that occur before, of texts with 30 words or more
    ("clutter", 0.09, None),  # characters of words that are neither letters nor digits; of texts with 10 words or more
    ("length", 0.22, None),  # words' mean length's distance from 5, as a share of 5; of texts with 20 words or more
)
_LEAST_WORDS = {"repetition": 30, "stutter": 8, "length": 20, "clutter": 10}

#: Kinds of ASCII characters, and what is neither letter nor digit; longer runs than two.
_KINDS = bytes(65 if 65 <= c < 91 else 97 if 97 <= c < 123 else 57 if 48 <= c < 58 else c for c in range(256))
_PLAIN = bytes(c for c in range(256) if not bytes([c]).isalnum())
_RUN, _RUN_OF_TEXT = re.compile(rb"(.)\1{2,}", re.DOTALL), re.compile(r"(.)\1{2,}", re.DOTALL)
_BANG, _SYMBOLS = re.compile(rb"[!?]{2}"), re.compile(rb"[#$%&*@^~=+<>\\]{2}")


class _Kinds(dict):
    """Of characters beyond ASCII too, for str.translate."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = kind = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
        return kind


_kinds = _Kinds()


def shape(word: bytes) -> bytes:
    """Its kinds of characters, runs of one kind cut to two."""
    if word.isascii():
        return _RUN.sub(rb"\1\1", word.translate(_KINDS))[:12]
    return _RUN_OF_TEXT.sub(r"\1\1", word.decode("utf-8", "replace").translate(_kinds))[:12].encode()


class Words:
    """Numbers of distinct words, and what labellers know of each; the scorer too, unless `scored` is false."""

    def __init__(self, scored: bool = True):
        self.scored = scored
        self.known: dict[bytes, int] = {}
        self.flags, self.hashed = np.zeros((0, 4), bool), np.zeros((0, 4), np.int64)

    def look(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.__init__(self.scored)
        known, fresh = self.known, []
        for w in words:
            if w not in known:
                known[w] = len(known)
                fresh.append(w)
        if fresh:
            flags, hashed, scored = [], [], self.scored
            for w in fresh:
                if w.isascii():
                    n, plain = len(w), w.isalnum()
                    flags.append((n > 1 and w.isupper(), not plain and _BANG.search(w) is not None, n == 1 and w in b"|/\\-_=+*#~<>", not plain and _SYMBOLS.search(w) is not None))
                    hashed.append((zlib.crc32(w.lower(), 3) % WIDTH if scored else 0, zlib.crc32(shape(w)) if scored else 0, n, n if plain else len(w.translate(None, _PLAIN))))
                    continue
                text = w.decode("utf-8", "replace")
                plain = text.isalnum()
                flags.append((len(text) > 1 and text.isupper(), not plain and _BANG.search(w) is not None, False, not plain and _SYMBOLS.search(w) is not None))
                hashed.append((zlib.crc32(w.lower(), 3) % WIDTH if scored else 0, zlib.crc32(shape(w)) if scored else 0, len(text), len(text) if plain else sum(map(str.isalnum, text))))
            self.flags = np.concatenate([self.flags, np.array(flags, dtype=bool)])
            self.hashed = np.concatenate([self.hashed, np.array(hashed, dtype=np.int64)])
        return np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))


def known_words(scored: bool = True) -> Words:
    """One for a worker: what it knows of words serves all its tasks."""
    return remembered(("quality", scored), lambda: Words(scored))


def examine(texts: list[bytes], memory: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, votes, features, owner): numbers of words, votes -1, 0, 1, and a document's hashed features in turn; none of these
    from a memory without what the scorer knows."""
    split = [t.split() for t in texts]
    n = np.array([len(w) for w in split], dtype=np.int64)
    at = memory.look(list(chain.from_iterable(split)))
    doc, place = np.repeat(np.arange(len(n)), n), spans(n)
    some = np.maximum(n, 1)
    share = {name: np.bincount(doc, memory.flags[at, k], len(n)) / some for k, name in ((0, "shouting"), (1, "exclaiming"), (2, "separators"), (3, "symbols"))}
    size, plain = (np.bincount(doc, memory.hashed[at, k], len(n)) for k in (2, 3))
    share["clutter"] = 1 - plain / np.maximum(size, 1)
    share["length"] = np.abs(size / some / 5 - 1)
    again = np.zeros(len(at), bool)
    again[1:] = (at[1:] == at[:-1]) & (place[1:] > 0)
    share["stutter"] = np.bincount(doc, again, len(n)) / some
    distinct = np.bincount(np.unique(doc * (len(memory.known) + 1) + at) // (len(memory.known) + 1), minlength=len(n))
    share["repetition"] = (n - distinct) / some
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    share["lines"] = np.array([1 - len(set(x)) / len(x) if x else 0.0 for x in lines])
    enough = {"lines": np.array([len(x) >= 4 for x in lines])}
    votes = np.zeros((len(n), len(LABELLERS)), dtype=np.int8)
    for k, (name, junk, good) in enumerate(LABELLERS):
        able = enough.get(name, n >= _LEAST_WORDS.get(name, 1)) & (n > 0)
        votes[:, k] = np.where(able & (share[name] >= junk), -1, np.where(able & (share[name] <= (-1.0 if good is None else good)), 1, 0))
    if not memory.scored:
        return n, votes, np.zeros(0, np.int64), np.zeros(0, np.int64)
    word, form = memory.hashed[at, 0], memory.hashed[at, 1]
    after = np.where(place + 1 < n[doc], np.roll(form, -1), 0)
    features = np.stack([word, form % WIDTH, (form * 31 + after * 17) % WIDTH, np.where(again, 7, form % 5 + 11)], axis=1)
    return n, votes, features.reshape(-1), np.repeat(doc, 4)


def vote_text(votes: np.ndarray) -> list[str]:
    """A character for each labeller: + good, - junk, . nothing."""
    return ["".join("-.+"[v + 1] for v in row) for row in votes.tolist()]


def estimate(patterns: dict[str, int], rounds: int = 100) -> tuple[dict[str, float], np.ndarray, float]:
    """P(good) of each pattern of votes, each labeller's accuracy, and P(good) of all.

    A labeller that votes is right with its accuracy, whatever the document is, and whether it votes says nothing. Both
    the accuracies and the share of good documents start from a prior, worth a few votes: heuristics are mostly right.
    """
    names = sorted(patterns)
    weight = np.array([patterns[p] for p in names], dtype=float)
    vote = np.array([["-.+".index(c) - 1 for c in p] for p in names])
    accuracy, prior = np.full(vote.shape[1], 0.9), 0.8
    for _ in range(rounds):
        logs = np.log(accuracy) - np.log1p(-accuracy)
        odds = np.log(prior) - np.log1p(-prior) + vote @ logs
        posterior = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        right = np.where(vote > 0, posterior[:, None], np.where(vote < 0, 1 - posterior[:, None], 0.0))
        accuracy = np.clip((weight @ right + 9) / (weight @ (vote != 0) + 10), 0.55, 0.995)
        prior = float((weight @ posterior + 8) / (weight.sum() + 10))
    return dict(zip(names, posterior.tolist(), strict=True)), accuracy, prior


def fit(rows: list[tuple[list[int], list[float], float]], prior: float = 0.5, passes: int = 300) -> np.ndarray:
    """Weights (the last is the bias) by logistic regression on (features, values, P(good)).

    Both sides have equal weight in training; the bias then makes up for the share of good documents, `prior`.
    """
    weights = np.zeros(WIDTH + 1)
    if not rows:
        return weights
    owner = np.repeat(np.arange(len(rows)), [len(f) for f, _, _ in rows])
    at, value = np.array(list(chain.from_iterable(f for f, _, _ in rows))), np.array(list(chain.from_iterable(v for _, v, _ in rows)))
    y = np.array([p for _, _, p in rows])
    side = np.where(y > 0.5, 1 / max(1, (y > 0.5).sum()), 1 / max(1, (y <= 0.5).sum()))
    square = np.full_like(weights, 1e-8)
    for _ in range(passes):
        z = np.bincount(owner, weights[at] * value, len(rows)) + weights[-1]
        gap = (y - 1 / (1 + np.exp(-z))) * side
        step = np.append(np.bincount(at, gap[owner] * value, WIDTH), gap.sum()) - 1e-5 * weights
        square += step * step
        weights += 0.5 * step / np.sqrt(square)
    weights[-1] += np.log(prior) - np.log1p(-prior)
    return weights


def _votes(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = known_words(scored=False)
        for b in batches:
            for ids, texts in chunks(b.column("doc_id").to_pylist(), as_bytes(b.column("text"))):
                n, votes, _, _ = examine(texts, memory)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n), pa.array(vote_text(votes))], names=["doc_id", "n_words", "votes"])

    return docs.mapInArrow(run, "doc_id long, n_words long, votes string")


def _vectors(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = known_words()
        for b in batches:
            for (_, texts), good in zip(chunks([None] * b.num_rows, as_bytes(b.column("text")), 1), b.column("good").to_pylist(), strict=True):
                n, _, features, _ = examine(texts, memory)
                at, count = np.unique(features, return_counts=True)
                yield pa.RecordBatch.from_pydict({"at": pa.array([at.tolist()], pa.list_(pa.int64())), "value": pa.array([(count / (int(n[0]) + DAMPING)).tolist()], pa.list_(pa.float64())), "good": pa.array([good])})

    return docs.select("text", "good").mapInArrow(run, "at array<long>, value array<double>, good double")


def weak_model(docs: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, float], np.ndarray, float, np.ndarray]:
    """What `estimate` finds in all of docs (text), and the scorer's weights."""
    # Texts are drawn, not rows: equal ones have equal votes, and ids may be missing or shared.
    docs = own_columns(docs, "text").where("text is not null").select(F.xxhash64("text").alias("doc_id"), "text")
    votes = stash(_votes(docs).where("n_words > 0"), "votes")
    counts = {r["votes"]: r["count"] for r in votes.groupBy("votes").count().collect()}  # at most 3^labellers rows
    if not counts:
        return {}, np.full(len(LABELLERS), 0.9), 0.8, np.zeros(WIDTH + 1)
    posterior, accuracy, prior = estimate(counts)
    known = docs.sparkSession.createDataFrame(list(posterior.items()), "votes string, good double")  # as many rows as counts
    rated = votes.join(F.broadcast(known), "votes").select("doc_id", "good")
    sides = {True: sum(n for p, n in counts.items() if posterior[p] > 0.5), False: sum(n for p, n in counts.items() if posterior[p] <= 0.5)}
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) / (1 << 30)
    limit = F.when(F.col("good") > 0.5, min(1.0, 2 * sample / max(1, sides[True]))).otherwise(min(1.0, 2 * sample / max(1, sides[False])))
    some = rated.withColumn("drawn", drawn).where(F.col("drawn") <= limit).groupBy("doc_id").agg(F.min("good").alias("good"), F.first("drawn").alias("drawn"))
    picked = [r for side in ("good > 0.5", "good <= 0.5") for r in some.where(side).orderBy("drawn", "doc_id").limit(sample).collect()]
    ids = docs.sparkSession.createDataFrame([(r["doc_id"], r["good"]) for r in picked], "doc_id long, good double")
    texts = docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("good").alias("good"))
    rows = [(r["at"], r["value"], r["good"]) for r in _vectors(texts).collect()]  # at most 2 * sample
    return posterior, accuracy, prior, fit(sorted(rows), prior)


def judge(docs: DataFrame, posterior: dict[str, float], weights: np.ndarray, least: float = 0.5) -> DataFrame:
    """(doc_id, n_words, votes, weak_good, score, keep) for each row of docs (doc_id, text).

    weak_good is the probability of good by the votes alone, score that of the scorer, in 0 to 1; keep says whether it is
    at least `least`. A null text, or one without words, has no votes, null weak_good, score 0 and isn't kept. Rows with
    the same or no doc_id are judged each by its text. Other columns aren't read; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((posterior, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known, w), memory = shared.value, known_words()
        for b in batches:
            for ids, texts in chunks(b.column("doc_id").to_pylist(), as_bytes(b.column("text"))):
                n, votes, features, owner = examine(texts, memory)
                z = np.bincount(owner, w[features], len(n)) / (n + DAMPING) + w[-1]
                score = np.where(n > 0, 1 / (1 + np.exp(-np.clip(z, -50, 50))), 0.0)
                told = vote_text(votes)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n), pa.array(told), pa.array([known.get(v) if k else None for v, k in zip(told, n, strict=True)], pa.float64()), pa.array(score), pa.array((score >= least) & (n > 0))], names=["doc_id", "n_words", "votes", "weak_good", "score", "keep"])

    return own_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_words long, votes string, weak_good double, score double, keep boolean")


def classify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """judge() with the model that weak_model() finds in the same documents."""
    posterior, _, _, weights = weak_model(docs, sample)
    return judge(docs, posterior, weights)
