"""Token ids of whole texts, as the tokenizers library gives them."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from tokenizers import Tokenizer, pre_tokenizers

from tracewell.llm.common import as_bytes, batch, chunks, remembered, slices, spans, trim

#: Distinct words whose ids a worker remembers; beyond that it forgets those seen once.
REMEMBERED = 400_000
#: Words encoded in one call, with a word of its own between any two.
AT_ONCE = 64
#: Texts of a batch that are Python objects at once.
SLICE = 2000
MARK = "\x01"
#: Stands for the end of a text among its words; no text holds these bytes.
END = b"\xff\xfe"
#: Of a word that ends with a letter and then symbols, those symbols are a word of their own to the tokenizer, so both parts
#: can be looked up. The apostrophe is left out, as some contractions have it.
_TAIL = rb"""!"#$%&()*+,-./:;<=>?@[\]^_`{|}~"""
_SYMBOLS = frozenset(_TAIL)


class _Grown:
    """An array that others are put behind, with room to spare; only its first n values count."""

    def __init__(self, x: np.ndarray):
        self.data, self.n = x, len(x)

    def append(self, x: np.ndarray) -> None:
        if (end := self.n + len(x)) > len(self.data):
            data = np.zeros(max(end, 3 * self.n // 2), self.data.dtype)
            data[: self.n] = self.data[: self.n]
            self.data = data
        self.data[self.n : end] = x
        self.n = end


def _taken(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of ids, sizes many each from starts, in turn."""
    ends = np.cumsum(sizes, dtype=np.int64)
    shift = (starts - (ends - sizes)).astype(np.int32)
    return ids[np.repeat(shift, sizes) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)]


def _distinct(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """(words, place): the different words of texts, and for each word of all texts, with END behind each text, which it is."""
    whole = b" ".join(x for t in texts for x in (t if END not in t else t.decode("utf-8", "replace").encode(), END)).lstrip()
    one = pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, len(whole)], np.int64)), pa.py_buffer(whole)])
    found = pc.ascii_split_whitespace(one).flatten().cast(pa.large_binary()).dictionary_encode()
    return found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy()  # to_pylist takes a microsecond a word


class WordEncoder:
    """Ids of texts by way of their words.

    For a tokenizer that drops white space and never joins what lies on two sides of it, the ids of a text are the ids
    of its words in turn. Each distinct word is encoded once and remembered. `Encoder` says which tokenizers qualify.
    """

    def __init__(self, tokenizer: Tokenizer, end_id: int):
        self.tokenizer = tokenizer
        # For words that need neither normalising nor splitting: the model itself, and what their letters are to it.
        self.model = tokenizer.model
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0x80, 0x100) if chr(c).isalpha()}
        (self.mark_id,) = tokenizer.encode(MARK, add_special_tokens=False).ids
        self._start({END: 0}, np.zeros(0, np.uint32), np.zeros(0, np.int32))
        self._add(np.array([end_id], np.uint32), np.array([1], np.int32))

    def _start(self, numbers: dict[bytes, int], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.numbers, self.ids, self.sizes = numbers, _Grown(ids), _Grown(sizes)
        self.starts = _Grown((np.cumsum(sizes, dtype=np.int64) - sizes).astype(np.int32))
        self.again = _Grown(np.zeros(len(sizes), bool))  # met in more than one call

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.starts.append(self.ids.n + np.cumsum(sizes) - sizes)
        self.sizes.append(sizes)
        self.ids.append(ids)
        self.again.append(np.zeros(len(sizes), bool))

    def _known(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words by number, in turn, and how many each has."""
        sizes = self.sizes.data[at]
        return _taken(self.ids.data, self.starts.data[at], sizes), sizes

    def _forget(self) -> None:
        """Keeps words met again, or half as many as may be remembered."""
        keep = np.union1d([0], np.flatnonzero(self.again.data[: self.again.n])[-REMEMBERED // 2 :])
        chosen = np.zeros(len(self.numbers), bool)
        chosen[keep] = True
        words = list(compress(self.numbers, chosen.tolist()))
        self.numbers = {}  # the old one goes before the new one grows
        self._start(dict(zip(words, range(len(words)), strict=True)), *self._known(keep))
        trim()

    def _plain(self, text: list[str]) -> tuple[np.ndarray, np.ndarray]:
        tokenize, letters = self.model.tokenize, self.letters
        each = [[t.id for t in tokenize(x if x.isascii() else x.translate(letters))] for x in text]
        return np.fromiter(chain.from_iterable(each), np.uint32), np.fromiter(map(len, each), np.int64, len(each))

    def _marked(self, text: list[str]) -> tuple[np.ndarray, np.ndarray]:
        runs = [f" {MARK} ".join(text[k : k + AT_ONCE]) for k in range(0, len(text), AT_ONCE)]
        found = self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(x for e in found for x in (e.ids, [self.mark_id])), dtype=np.uint32)
        marks = ids == self.mark_id
        n, ids = np.diff(np.flatnonzero(marks), prepend=-1) - 1, ids[~marks]
        # Else a tokenizer that sees other words than these.
        return (ids, n) if len(n) == len(text) and n.sum() == len(ids) else self._alone(text)

    def _alone(self, text: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, np.uint32) for x in text]
        return np.concatenate(each), np.array([len(x) for x in each])

    def _encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in turn, and their numbers."""
        text = [w.decode("utf-8", "replace") for w in words]
        # Small letters up to \xff stay as they are and make one word. Of others it is up to the tokenizer what they become, so
        # they get a mark behind them; those that may hold a special token or the mark are encoded alone.
        kind = np.array([0 if x.isalpha() and (x.isascii() or max(x) <= "\xff") and x == x.lower() else 2 if "<|" in x or MARK in x else 1 for x in text])
        every: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for k, encode in enumerate((self._plain, self._marked, self._alone)):
            if len(at := np.flatnonzero(kind == k)):
                every.append((at, *encode([text[k] for k in at.tolist()])))
        sizes = np.zeros(len(words), np.int32)
        starts, base = np.zeros(len(words), np.int64), 0
        for at, ids, n in every:
            sizes[at], starts[at] = n, base + np.cumsum(n) - n
            base += len(ids)
        ids = np.concatenate([x for _, x, _ in every])
        return ids[np.repeat(starts, sizes) + spans(sizes)], sizes

    def _learn(self, words: list[bytes]) -> None:
        known, learned = self.numbers, self.starts.n
        need: dict[bytes, int] = {}
        parts, counts = [], np.ones(len(words), np.int64)
        for k, w in enumerate(words):
            if w[-1] in _SYMBOLS and b"a" <= (head := w.rstrip(_TAIL))[-1:] <= b"z" and b"<|" not in w:
                counts[k] = 2
                for x in (head, w[len(head) :]):
                    at = known.get(x, -1)
                    parts.append(at if at >= 0 else learned + need.setdefault(x, len(need)))
            else:
                parts.append(learned + need.setdefault(w, len(need)))
        ids, sizes = self._encoded(list(need))
        # Parts known before, then those just encoded; a word's own ids are those of its part or two.
        part = np.array(parts, dtype=np.int64)
        old = part < learned
        used, place = np.unique(part[old], return_inverse=True)
        old_ids, old_sizes = self._known(used)
        part[~old] += len(used) - learned
        part[old] = place
        sizes = np.concatenate([old_sizes, sizes.astype(np.int32)])
        starts = np.cumsum(sizes, dtype=np.int64) - sizes
        own = sizes[part]
        self._add(_taken(np.concatenate([old_ids, ids]), starts[part], own), np.add.reduceat(own, np.cumsum(counts) - counts))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in turn, each text's with the end id behind them, and their numbers."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(self.numbers) > REMEMBERED:
            self._forget()
        # ASCII letters are lower-cased at once. Where a special token's text might be, that is left to the tokenizer, and
        # where combining marks are (their first bytes are \xcc and \xcd): it composes before it lower-cases.
        low = [t if b"<|" in t or b"\xcc" in t or b"\xcd" in t else t.lower() for t in texts]
        words, place = _distinct(low)
        own = np.fromiter(map(self.numbers.get, words, repeat(-1)), dtype=np.int32, count=len(words))
        new = own < 0
        self.again.data[own[~new]] = True
        if new.any():
            own[new] = np.arange(len(self.numbers), len(self.numbers) + new.sum())
            fresh = list(compress(words, new.tolist()))
            self._learn(fresh)
            self.numbers.update(zip(fresh, own[new].tolist(), strict=True))
        at = own[place]
        ids, sizes = self._known(at)
        ends = np.cumsum(sizes, dtype=np.int64)[at == 0]
        return ids, np.diff(ends, prepend=0)


class Encoder:
    """Ids of texts; by words where the tokenizer's settings allow it, else by whole texts."""

    def __init__(self, path: str, end_id: int):
        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        pre = (said.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        pattern = (pre[0].get("pattern") or {}).get("Regex", "")
        by_words = len(pre) == 2 and pre[0].get("behavior") == "Removed" and pre[0].get("invert") is True and pattern.endswith(r"[^\s\p{L}\p{N}]+") and " " not in pattern and not pre[1].get("add_prefix_space")
        by_words = by_words and all(t["special"] and not t["normalized"] and not t["lstrip"] and not t["rstrip"] and "<|" in t["content"] for t in said["added_tokens"])
        lower = "Lowercase" in str(said.get("normalizer")) and said["model"].get("end_of_word_suffix") == "</w>"
        self.words = WordEncoder(self.tokenizer, end_id) if by_words and lower and len(self.tokenizer.encode(MARK, add_special_tokens=False).ids) == 1 else None

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in turn, each text's with the end id behind them, and their numbers."""
        if self.words is not None:
            return self.words.encode(texts)
        found = [np.array([*e.ids, self.end_id], dtype=np.uint32) for e in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
        return (np.concatenate(found) if found else np.zeros(0, np.uint32)), np.array([len(x) for x in found], dtype=np.int64)


def encoder_of(path: str, end_id: int) -> Encoder:
    """One for a worker: what it remembers serves all its tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return remembered(("tokens", path, end_id), lambda: Encoder(path, end_id))


def pack_ids(ids: np.ndarray, squeeze: zstandard.ZstdCompressor) -> bytes:
    """Ids as compressed little-endian integers, two bytes each where all fit."""
    return (b"\x02" + squeeze.compress(ids.astype("<u2").tobytes())) if not len(ids) or ids.max() < 1 << 16 else (b"\x04" + squeeze.compress(ids.astype("<u4").tobytes()))


def unpack_ids(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob[1:]), dtype="<u2" if blob[0] == 2 else "<u4").astype(np.uint32)


def crc32_ids(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))


TOKENIZED = "doc_id long, n_tokens long, ids_crc32 long, ids binary, salt long"


def tokenize(docs: DataFrame, path: str, end_id: int = 1, counts: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, ids, salt) for each row of docs (doc_id, text).

    A null text is empty and has the end id alone. Ids are compressed. salt tells apart rows with the same doc_id that
    one task reads; it is the row's place in that task's input. With `counts`, each task ends with a row whose n_tokens is -1
    and whose ids are the number of times that each id from 0 on has occurred.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, squeeze = encoder_of(path, end_id), zstandard.ZstdCompressor(level=1)
        out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary()), ("salt", pa.int64())])
        place, sums = 0, np.zeros(0, np.int64)
        for b in chain.from_iterable(slices(x, SLICE) for x in batches):
            for doc_ids, texts in chunks(b.column("doc_id").to_pylist(), as_bytes(b.column("text"))):
                ids, lengths = encoder.encode(texts)
                parts = np.split(ids, np.cumsum(lengths)[:-1])
                yield batch(out, doc_id=doc_ids, n_tokens=lengths, ids_crc32=[crc32_ids(x) for x in parts], ids=[pack_ids(x, squeeze) for x in parts], salt=np.arange(place, place + len(parts)))
                place += len(parts)
                if counts:
                    n = np.bincount(ids)
                    sums = np.concatenate([sums, np.zeros(max(0, len(n) - len(sums)), np.int64)])
                    sums[: len(n)] += n
        if counts:
            yield batch(out, doc_id=[None], n_tokens=[-1], ids_crc32=[0], ids=[squeeze.compress(sums.tobytes())], salt=[place])

    return docs.select("doc_id", "text").mapInArrow(run, TOKENIZED)
