"""Language identification with a linear-chain conditional random field over words.

Each word has features: affixes and n-grams of its letters, the word itself, and membership in each language's lexicon of
frequent words. Weights of features and transitions between neighbours' languages are learned from texts of known
language, spliced into sequences that switch between them. Forward-backward gives each word's language probabilities,
and a document's language is that of most probability over its words with letters.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import as_bytes, chunks, crc32_text, own_columns, remembered, slices, spans

#: Training documents of each language, at most; languages, at most (the most frequent).
SAMPLE, LANGUAGES = 300, 256
#: Spliced training sequences, words of each, and passes over them.
SEQUENCES, STRETCH, PASSES = 1600, 64, 4
#: Hashed features, and words in each language's lexicon.
WIDTH, LEXICON = 1 << 16, 200
#: Words of a run. Runs of a chain are gone through side by side; messages between them keep the chain whole.
RUN = 224
#: Words after which numbers are brought back to a sum of 1.
SCALED = 4
#: Distinct words whose scores a worker remembers.
REMEMBERED = 300_000


def core(word: bytes) -> bytes:
    """The word's letters, lower-cased; empty without letters."""
    w = word.decode("utf-8", "replace").lower()
    return (w if w.isalpha() else "".join(filter(str.isalpha, w))).encode()


def features(c: bytes) -> list[int]:
    """Hashed affixes (up to 4 letters), n-grams (1 to 4 letters) and the whole of a word's letters."""
    out, n = [zlib.crc32(c, 1)], len(c)
    if c.isascii():
        for k in range(1, min(4, n) + 1):
            out += (zlib.crc32(c[:k], 10 + k), zlib.crc32(c[n - k :], 20 + k))
        for k in (2, 3, 4):
            out += [zlib.crc32(c[i : i + k], 30 + k) for i in range(n - k + 1)]
    else:
        at = [k for k, x in enumerate(c) if x & 0xC0 != 0x80]  # where letters begin among the bytes, and the end
        n, at = len(at), [*at, n]
        for k in range(1, min(4, n) + 1):
            out += (zlib.crc32(c[: at[k]], 10 + k), zlib.crc32(c[at[n - k] :], 20 + k))
        for k in (1, 2, 3, 4):  # a letter beyond ASCII tells by itself
            out += [zlib.crc32(c[at[i] : at[i + k]], 30 + k) for i in range(n - k + 1)]
    return [x & (WIDTH - 1) for x in out]


#: What a byte with so many behind it adds to a crc32 (the places of a crc add up by xor), within WIDTH; and what the crc32 of
#: so many zeros is, begun with a number.
_ADDS = np.array([[(zlib.crc32(bytes([b]) + bytes(k)) ^ zlib.crc32(bytes(k + 1))) & (WIDTH - 1) for b in range(256)] for k in range(16)], dtype=np.uint16)
_ZEROS = np.array([[zlib.crc32(bytes(k), x) & (WIDTH - 1) for k in range(17)] for x in range(35)], dtype=np.int64)


def features_of(cores: list[bytes], ascii_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """features() of words with letters, one after the other, and how many each has; of words all with letters beyond ASCII, or
    all without. All words at once: a piece of up to 4 letters, 16 bytes, is told by where it begins and its bytes."""
    text = np.frombuffer(b"".join(cores), np.uint8)
    size = np.fromiter(map(len, cores), np.int64, len(cores))
    letters = np.flatnonzero((text & 0xC0) != 0x80)
    begin = np.searchsorted(letters, np.cumsum(size) - size)
    n, letters = np.diff(begin, append=len(letters)), np.append(letters, len(text))
    added = [_ADDS[0][text]]  # added[m - 1][p]: what the m bytes from p on add up to
    for k in range(1, min(4 if ascii_only else 16, len(text))):
        added.append(np.zeros_like(added[0]))
        added[k][: len(text) - k] = _ADDS[k][text[: len(text) - k]] ^ added[k - 1][1 : len(text) - k + 1]
    added = np.stack(added)
    lengths = (2, 3, 4) if ascii_only else (1, 2, 3, 4)  # a letter beyond ASCII tells by itself
    grams = [np.clip(n - k + 1, 0, None) for k in lengths]
    sizes = 1 + 2 * np.minimum(n, 4) + sum(grams)
    first = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.int64)

    def put(to: np.ndarray, letter: np.ndarray, k: int, number: int) -> None:
        start = letters[letter]
        m = letters[letter + k] - start
        out[to] = added[m - 1, start] ^ _ZEROS[number][m]

    out[first] = np.fromiter((zlib.crc32(c, 1) & (WIDTH - 1) for c in cores), np.int64, len(cores))
    for k in (1, 2, 3, 4):
        able = n >= k
        put(first[able] + 2 * k - 1, begin[able], k, 10 + k)
        put(first[able] + 2 * k, (begin + n)[able] - k, k, 20 + k)
    at = first + 1 + 2 * np.minimum(n, 4)
    for k, some in zip(lengths, grams, strict=True):
        own = spans(some)
        put(np.repeat(at, some) + own, np.repeat(begin, some) + own, k, 30 + k)
        at = at + some
    return out, sizes


class Rated:
    """Distinct words met so far, with their scores and whether they have letters."""

    def __init__(self, languages: int):
        self.known: dict[bytes, int] = {}
        self.scores, self.letters = np.zeros((0, languages), np.float32), np.zeros(0, bool)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    lexicon: dict[bytes, np.ndarray]
    lexical: np.ndarray
    transitions: np.ndarray
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def emissions(self, cores: list[bytes]) -> np.ndarray:
        """Log scores of each language for words given by their letters; zero for words without."""
        out = np.zeros((len(cores), len(self.languages)))
        plain = [k for k, c in enumerate(cores) if c and c.isascii()]
        other = [k for k, c in enumerate(cores) if c and not c.isascii()]
        for some in (plain, other):
            if not some:
                continue
            flat, sizes = features_of([cores[k] for k in some], some is plain)
            out[some] = np.add.reduceat(self.weights[flat], np.cumsum(sizes) - sizes, axis=0) / np.sqrt(sizes)[:, None]
            for k in some:
                if (flags := self.lexicon.get(cores[k])) is not None:
                    out[k] += flags @ self.lexical
        return out

    def rate(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Emissions of words, and which have letters; distinct words are rated once and remembered."""
        rated = remembered(("language", self.name), lambda: Rated(len(self.languages)))
        if len(rated.known) > REMEMBERED:
            rated.__init__(len(self.languages))
        known, fresh = rated.known, []
        for w in words:
            if w not in known:
                known[w] = len(known)
                fresh.append(w)
        if fresh:
            cores = [core(w) for w in fresh]
            parts = [self.emissions(cores[k : k + 8192]).astype(np.float32) for k in range(0, len(cores), 8192)]
            rated.scores = np.concatenate([rated.scores, *parts])
            rated.letters = np.concatenate([rated.letters, np.array([bool(c) for c in cores])])
        at = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))
        return rated.scores[at], rated.letters[at]

    def judge(self, texts: list[bytes], runs: bool = False) -> tuple[np.ndarray, list[str], np.ndarray, list]:
        """(words, language, score, runs) of texts."""
        split = [t.split() for t in texts]
        n = np.array([len(w) for w in split], dtype=np.int64)
        e, letters = self.rate(list(chain.from_iterable(split)))
        known = len(self.languages) > 0
        gamma = _decided(e, n, self.transitions) if known and len(e) else np.zeros((len(e), max(1, len(self.languages))))
        ends = np.cumsum(n)
        sums = np.concatenate([np.zeros((1, gamma.shape[1])), np.cumsum(gamma * letters[:, None], axis=0)])
        votes, of = sums[ends] - sums[ends - n], np.diff(np.concatenate([[0], np.cumsum(letters)])[ends], prepend=0)
        best = votes.argmax(1)
        told = [self.languages[k] if c and known else "und" for k, c in zip(best, of, strict=True)]
        score = np.where((of > 0) & known, np.clip(votes[np.arange(len(n)), best] / np.maximum(of, 1), 0, 1), 0.0)
        listed = [_runs(gamma[e - k : e].argmax(1), self.languages) if known else [] for e, k in zip(ends, n, strict=True)] if runs else [None] * len(n)
        return n, told, score, listed


def forward_backward(e: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, before: np.ndarray | None = None, behind: np.ndarray | None = None) -> np.ndarray:
    """Label probabilities at each place of sequences; e: log scores (sequences, places, labels), beyond lengths ignored.

    A row of `before` is what the words in front of a sequence say of its first label (all 1: there are none), a row of
    `behind` what those after it say of its last.
    """
    n, places, labels = e.shape
    x = np.exp(e - e.max(2, keepdims=True))
    a = np.exp(transitions - transitions.max())
    forward, backward = np.empty_like(x), np.empty_like(x)
    now = x[:, 0] if before is None else x[:, 0] * before
    now = now / now.sum(1, keepdims=True)
    forward[:, 0] = now
    for t in range(1, places):
        now = (now @ a) * x[:, t]
        if not t % SCALED:  # factors that a place's probabilities have in common don't matter
            now /= now.sum(1, keepdims=True)
        forward[:, t] = now
    shortest = int(lengths.min())
    end = np.full((n, labels), 1 / labels) if behind is None else behind
    now = end.copy()
    backward[:, -1] = now
    for t in range(places - 2, -1, -1):
        now = (now * x[:, t + 1]) @ a.T
        if not t % SCALED:
            now /= now.sum(1, keepdims=True)
        if t + 1 >= shortest:
            last = t + 1 >= lengths
            now[last] = end[last]
        backward[:, t] = now
    out = forward * backward
    return out / out.sum(2, keepdims=True)


def _passage(e: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """For each sequence a matrix, up to a factor: from its first word's label (before that word is seen) to its last."""
    x = np.exp(e - e.max(2, keepdims=True))
    a = np.exp(transitions - transitions.max())
    n, places, labels = x.shape
    now, shortest = np.eye(labels)[None] * x[:, :1], int(lengths.min())
    for t in range(1, places):
        new = (now.reshape(-1, labels) @ a).reshape(n, labels, labels)
        new *= x[:, t][:, None]
        if not t % SCALED:
            new /= new.sum((1, 2), keepdims=True)
        now = new if t < shortest else np.where((t < lengths)[:, None, None], new, now)
    return now / now.sum((1, 2), keepdims=True)


def _messages(passages: np.ndarray, first: np.ndarray, count: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each run is told from before and from behind, for chains of runs first[k], ..., first[k] + count[k] - 1."""
    a = np.exp(transitions - transitions.max())
    labels = len(a)
    before, behind = np.ones((len(passages), labels)), np.full((len(passages), labels), 1 / labels)
    for k in range(1, int(count.max(initial=1))):
        at = first[count > k] + k
        told = np.einsum("ni,nij->nj", before[at - 1], passages[at - 1]) @ a
        before[at] = told / told.sum(1, keepdims=True)
        at = (first + count)[count > k] - k
        told = np.einsum("nij,nj->ni", passages[at], behind[at]) @ a.T
        behind[at - 1] = told / told.sum(1, keepdims=True)
    return before, behind


def _expected(e: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities, and expected numbers of neighbouring labels."""
    places = e.shape[1]
    gamma = forward_backward(e, lengths, transitions)
    # Neighbours' joint probabilities, from one more forward and backward pass with what they lack.
    x = np.exp(e - e.max(2, keepdims=True))
    a = np.exp(transitions - transitions.max())
    now, fw = x[:, 0] / x[:, 0].sum(1, keepdims=True), [x[:, 0] / x[:, 0].sum(1, keepdims=True)]
    for t in range(1, places):
        now = (now @ a) * x[:, t]
        now /= now.sum(1, keepdims=True)
        fw.append(now)
    joint, back = np.zeros_like(a), np.ones_like(x[:, 0])
    for t in range(places - 1, 0, -1):
        both = fw[t - 1][:, :, None] * a[None] * (x[:, t] * back)[:, None, :]
        both /= both.sum((1, 2), keepdims=True)
        joint += both[t < lengths].sum(0)
        back = (x[:, t] * back) @ a.T
        back /= back.sum(1, keepdims=True)
        back[t >= lengths] = 1.0
    return gamma, joint


def train(texts: list[tuple[str, str]], seed: int = 7) -> Model:
    """texts: (language, text). Deterministic for the same texts in the same order."""
    rng = np.random.default_rng(seed)
    languages = sorted({lang for lang, _ in texts})
    number = {x: k for k, x in enumerate(languages)}
    split = {x: [] for x in languages}
    for lang, text in texts:
        if w := text.encode().split():
            split[lang].append(w)
    usable = [x for x in languages if split[x]]
    counts = {x: Counter(core(w) for doc in split[x] for w in doc) for x in languages}
    lexicon: dict[bytes, np.ndarray] = {}
    for x in languages:
        for c, _ in sorted(((c, n) for c, n in counts[x].items() if c), key=lambda p: (-p[1], p[0]))[:LEXICON]:
            lexicon.setdefault(c, np.zeros(len(languages)))[number[x]] = 1.0
    model = Model(languages, np.zeros((WIDTH, len(languages))), lexicon, np.zeros((len(languages),) * 2), np.zeros((len(languages),) * 2))
    if not usable:
        return model

    vocabulary: dict[bytes, int] = {}
    words, labels = np.zeros((SEQUENCES, STRETCH), np.int64), np.zeros((SEQUENCES, STRETCH), np.int64)
    for k in range(SEQUENCES):
        at = 0
        while at < STRETCH:  # half of the sequences keep to one language
            lang = usable[int(rng.integers(len(usable)))] if at == 0 or k % 2 else lang
            doc = split[lang][int(rng.integers(len(split[lang])))]
            n = min(STRETCH - at, len(doc), int(rng.integers(4, 24)) if k % 2 else STRETCH)
            start = int(rng.integers(len(doc) - n + 1))
            words[k, at : at + n] = [vocabulary.setdefault(w, len(vocabulary)) for w in doc[start : start + n]]
            labels[k, at : at + n] = number[lang]
            at += n
    cores = [core(w) for w in vocabulary]
    found = [features(c) if c else [] for c in cores]
    sizes = np.array([len(x) for x in found])
    flat, owner = np.fromiter(chain.from_iterable(found), dtype=np.int64), np.repeat(np.arange(len(found)), sizes)
    scale = (1 / np.sqrt(np.maximum(sizes, 1)))[owner][:, None]
    flags = np.array([lexicon.get(c, np.zeros(len(languages))) for c in cores])
    eye, params = np.eye(len(languages)), (model.weights, model.lexical, model.transitions)
    square, rate = [np.full_like(p, 1e-6) for p in params], 0.3
    lengths = np.full(64, STRETCH)
    for _ in range(PASSES):
        order = rng.permutation(SEQUENCES)
        for s in range(0, SEQUENCES - 63, 64):
            w, y = words[order[s : s + 64]], labels[order[s : s + 64]]
            used, inverse = np.unique(w, return_inverse=True)
            mine = np.isin(owner, used)
            place = np.zeros(len(found), np.int64)
            place[used] = np.arange(len(used))
            score = flags[used] @ model.lexical
            np.add.at(score, place[owner[mine]], model.weights[flat[mine]] * scale[mine])
            gamma, joint = _expected(score[inverse.reshape(w.shape)], lengths, model.transitions)
            gap = np.zeros_like(score)
            np.add.at(gap, inverse.reshape(-1), (eye[y] - gamma).reshape(-1, len(languages)))
            seen = np.zeros_like(joint)
            np.add.at(seen, (y[:, :-1], y[:, 1:]), 1.0)
            step = np.zeros_like(model.weights)
            np.add.at(step, flat[mine], gap[place[owner[mine]]] * scale[mine])
            for p, g, q in zip(params, (step, flags[used].T @ gap, seen - joint), square, strict=True):
                q += g * g
                p += rate * g / np.sqrt(q)
    return model


def sample(docs: DataFrame, per_language: int = SAMPLE, languages: int = LANGUAGES) -> list[tuple[str, str]]:
    """At most `per_language` labelled texts of each of the `languages` most frequent languages, by a hash of doc_id."""
    labelled = docs.where("lang is not null and text is not null and length(trim(text)) > 0")
    counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    if not counts:
        return []
    share = F.create_map(*chain.from_iterable((F.lit(r["lang"]), F.lit(min(1.0, 2 * per_language / r["count"] + 0.0))) for r in counts))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / (1 << 30)
    some = labelled.withColumn("drawn", drawn).where(F.col("drawn") <= F.element_at(share, F.col("lang")))
    rank = Window.partitionBy("lang").orderBy("drawn", "doc_id", "text")
    rows = some.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= per_language).select("lang", "text", "rank").collect()
    return [(r["lang"], r["text"]) for r in sorted(rows, key=lambda r: (r["lang"], r["rank"]))]


RESULT = "doc_id long, lang_pred string, score double, words long, runs array<struct<lang:string,start:int,words:int>>"


def identify(docs: DataFrame, model: Model, runs: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score, words, runs) for each row of docs (doc_id, text).

    lang_pred is a learned language, or `und` with score 0 if the text is null or has no letter. score is the mean
    probability of that language over the words with letters, in 0 to 1; equal sums go to the first language by name.
    With `runs`, stretches of words that most probably have one language are listed (else null). A whole text is
    one chain. Rows with the same or no doc_id are kept. Other columns of docs
    aren't read. Without any learned language every row is `und`.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in chain.from_iterable(map(slices, batches)):
            for ids, texts in chunks(b.column("doc_id").to_pylist(), as_bytes(b.column("text"))):
                n, told, score, listed = m.judge(texts, runs)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(told), pa.array(score), pa.array(n), pa.array(listed, pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("words", pa.int32())])))], names=["doc_id", "lang_pred", "score", "words", "runs"])

    return docs.select("doc_id", "text").mapInArrow(run, RESULT)


def _runs(best: np.ndarray, languages: list[str]) -> list[dict]:
    cuts = np.flatnonzero(np.diff(best, prepend=-1)).tolist()
    return [] if not cuts else [{"lang": languages[best[s]], "start": s, "words": e - s} for s, e in zip(cuts, [*cuts[1:], len(best)], strict=True)]


def _decided(e: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Label probabilities of all words of documents with these lengths, each of which is one chain."""
    pieces = -(-lengths // RUN)
    left, own = np.repeat(lengths, pieces), spans(pieces) * RUN
    start, size = np.repeat(np.cumsum(lengths) - lengths, pieces) + own, np.minimum(left - own, RUN)
    first = np.cumsum(pieces) - pieces
    out = np.empty(e.shape, np.float64)

    def grouped(runs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Runs of about one size together, and their words' scores."""
        runs = runs[np.argsort(size[runs], kind="stable")]
        for s in range(0, len(runs), 512):
            at = runs[s : s + 512]
            take = np.minimum(np.arange(int(size[at].max()))[None], size[at][:, None] - 1) + start[at][:, None]
            yield at, e[take].astype(np.float64)

    labels = e.shape[1]
    passages = np.ones((len(size), labels, labels))
    for at, x in grouped(np.flatnonzero(left > RUN)):
        passages[at] = _passage(x, size[at], transitions)
    before, behind = _messages(passages, first, pieces, transitions)
    for at, x in grouped(np.arange(len(size))):
        gamma = forward_backward(x, size[at], transitions, before[at], behind[at])
        rows, cols = np.repeat(np.arange(len(at)), size[at]), spans(size[at])
        out[start[at][rows] + cols] = gamma[rows, cols]
    return out


def learned_split(docs: DataFrame) -> DataFrame:
    """The query: a model of documents whose crc32(doc_id) mod 4 isn't 2, applied to all."""
    docs = own_columns(docs, "doc_id", "text", "lang")
    held_out = F.coalesce(crc32_text(F.col("doc_id")) % 4 == 2, F.lit(False))
    model = train(sample(docs.where(~held_out)))
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least_score: float = 0.0) -> DataFrame:
    """The rows of docs whose language isn't `und`, with at least that score; all columns, lang replaced by it."""
    shared = docs.sparkSession.sparkContext.broadcast(train(sample(own_columns(docs, "doc_id", "text", "lang"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chain.from_iterable(map(slices, batches)):
            told, keep = [], []
            for _, texts in chunks([None] * b.num_rows, as_bytes(b.column("text"))):
                _, langs, score, _ = shared.value.judge(texts)
                told += langs
                keep += [lang != "und" and x >= least_score for lang, x in zip(langs, score, strict=True)]
            at = b.schema.get_field_index("lang")
            yield b.set_column(at, b.schema.field(at), pa.array(told, pa.string()).cast(b.schema.field(at).type)).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
