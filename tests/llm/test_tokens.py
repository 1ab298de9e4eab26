import random
import unicodedata
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tracewell.llm import packing, token_files, tokens
from tracewell.llm.common import tokenizer_path

PATH = tokenizer_path()


@pytest.fixture(scope="module")
def want(rows):
    t = Tokenizer.from_file(PATH)
    return [(i, np.array([*t.encode(x, add_special_tokens=False).ids, 1], dtype="<u4")) for i, x in rows]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.sampled_from(["a.,b ", "it's'", "WORD!! x", "<|endoftext|>.", "a\x01.", "é... ", "İ", "don't.", "x<|y|>"])), max_size=6))
def test_words_give_the_same_ids(parts):
    text = "".join(parts).encode("utf-8", "replace")
    encoder = tokens.encoder_of(PATH, 1)
    assert encoder.words is not None
    ids, sizes = encoder.encode([text, b"a", text])
    want = Tokenizer.from_file(PATH).encode(text.decode(), add_special_tokens=False).ids
    assert ids[: sizes[0]].tolist() == [*want, 1] == ids[len(ids) - sizes[2] :].tolist()


def test_letters_and_marks_of_all_scripts():
    every = [chr(c) for c in range(0x80, 0x110000) if unicodedata.category(chr(c))[0] in "LM"]
    marks = [c for c in every if unicodedata.category(c)[0] == "M"]
    rng = random.Random(4)
    texts = [c + " b" + c + " " for c in every[::7]]
    for _ in range(4000):
        own = rng.choice([every, marks, every[:600]])
        texts.append("".join(rng.choice(own) if rng.random() < 0.7 else rng.choice("aBJHTWY .'!\x85\u3000\u0958\u0932") for _ in range(rng.randrange(1, 12))))
    ids, sizes = tokens.encoder_of(PATH, 1).encode([t.encode() for t in texts])
    want = [[*e.ids, 1] for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want


def test_a_word_is_looked_up_once_a_call():
    class Counted(dict):
        n = 0

        def get(self, *x):
            Counted.n += 1
            return super().get(*x)

    encoder = tokens.Encoder(PATH, 1)
    encoder.encode([b"a b c"])
    encoder.words.numbers = Counted(encoder.words.numbers)
    text = "a b c d \x0b\x1c\x85" * 500
    ids, sizes = encoder.encode([b"  ", text.encode(), b"", text.encode()])
    want = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert ids.tolist() == [1, *want, 1, 1, *want, 1] and sizes.tolist() == [1, len(want) + 1, 1, len(want) + 1]
    assert 5 <= Counted.n <= 12


def test_bytes_that_stand_for_the_end():
    encoder, t = tokens.Encoder(PATH, 1), Tokenizer.from_file(PATH)
    ids, sizes = encoder.encode([b"a \xff\xfe b", b"c"])
    assert ids.tolist() == [*t.encode("a \ufffd\ufffd b", add_special_tokens=False).ids, 1, *t.encode("c", add_special_tokens=False).ids, 1] and len(sizes) == 2


def test_forgetting(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    encoder, rng = tokens.Encoder(PATH, 1), random.Random(1)
    for _ in range(20):
        text = " ".join(rng.choice("abcdefgh") * rng.randrange(1, 9) + str(rng.randrange(99)) for _ in range(40))
        ids, _ = encoder.encode([text.encode()])
        assert ids.tolist() == [*Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids, 1]


def test_other_tokenizers_take_whole_texts():
    encoder = tokens.Encoder(tokenizer_path("byte_bpe_50k.json"), 0)
    assert encoder.words is None and encoder.encode([b"a b"])[0].tolist()[-1] == 0


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(1)
    counts = np.concatenate([rng.integers(0, 50, 200), 2 ** np.arange(40)])
    free = token_files.code_lengths(counts, 40)
    short = token_files.code_lengths(counts, 10)
    used = counts > 0
    assert short.max() <= 10 and ((free > 0) == used).all() and ((short > 0) == used).all()
    for x in (free, short):
        assert sum(2.0 ** -int(n) for n in x[used]) <= 1
    import heapq

    heap = [(int(c), k, 0) for k, c in enumerate(counts) if c]
    cost, k = 0, len(counts)
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[0], heapq.heappop(heap)[0]
        cost += a + b
        heapq.heappush(heap, (a + b, k := k + 1, 0))
    assert int((counts * free).sum()) == cost <= int((counts * short).sum())
    assert token_files.code_lengths(np.array([0, 5])).tolist() == [0, 1]


def test_bits_round_trip():
    rng = np.random.default_rng(2)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = np.minimum(rng.geometric(0.01, n), 900).astype(np.uint32)
        lengths = token_files.code_lengths(np.bincount(ids, minlength=901))
        bits, marks = token_files.encode_bits(ids, token_files.canonical(lengths), lengths)
        assert (token_files.decode_bits(bits, marks, n, token_files.decode_table(lengths)) == ids).all()


def test_files(docs, want):
    got = sorted(token_files.round_trip(docs, PATH).collect(), key=lambda r: r.start)
    want = sorted(want, key=lambda x: (-1 if x[0] is None else x[0], len(x[1])))
    start = 0
    for r, (i, ids) in zip(got, want, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.ids) == (i, start, len(ids), zlib.crc32(ids.tobytes()), ids.tolist())
        start += len(ids)
    assert token_files.round_trip(docs.limit(0), PATH).count() == 0


def test_packing(docs, want):
    pieces = packing.pack(docs, PATH, length=256).collect()
    sequences, by_doc = {}, {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
        by_doc.setdefault(p.doc_id, []).append(p)
        assert tokens.crc32_ids(tokens.unpack_ids(p.ids)) == p.ids_crc32
    for parts in sequences.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= 256 and (end == 256 or end & (end - 1) == 0)
    once = {i for i, _ in want if sum(j == i for j, _ in want) == 1}
    for i, ids in want:
        if i in once:
            own = sorted(by_doc[i], key=lambda p: p.start)
            assert [p.start for p in own] == np.cumsum([0, *[p.length for p in own[:-1]]]).tolist()
            assert np.concatenate([tokens.unpack_ids(p.ids) for p in own]).tolist() == ids.tolist()
            assert {p.doc_tokens for p in own} == {len(ids)}
    assert sum(p.length for p in pieces) == sum(len(x) for _, x in want)
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_costs_are_balanced():
    rng = random.Random(5)
    pieces = packing.pack_lengths([rng.randrange(20, 700) for _ in range(400)], 2048)
    spent = {}
    for _, _, n, s, _ in pieces:
        spent[s] = spent.get(s, 0) + packing.cost(n, 2048)
    full = [c for s, c in spent.items() if sum(n for _, _, n, q, _ in pieces if q == s) == 2048]
    assert max(full) < 1.5 * min(full)
