import itertools
import zlib

import numpy as np

from tracewell.llm import language_id as L


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    e, a = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3))
    for n in (4, 2, 1):
        want = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=n):
            p = np.exp(sum(e[0, t, y] for t, y in enumerate(path)) + sum(a[x, y] for x, y in itertools.pairwise(path)))
            for t, y in enumerate(path):
                want[t, y] += p
        got = L.forward_backward(e, np.array([n]), a)[0, :n]
        assert np.allclose(got, want / want.sum(1, keepdims=True))


def test_runs_agree_with_whole_chains():
    rng = np.random.default_rng(2)
    lengths = np.array([1, 700, 0, 224, 225, 33, 2000])
    e, a = rng.normal(size=(lengths.sum(), 4)), rng.normal(size=(4, 4)) + 9 * np.eye(4)
    got, at = L._decided(e, lengths, a), 0
    for n in lengths:
        if n:
            assert np.allclose(got[at : at + n], L.forward_backward(e[None, at : at + n], np.array([n]), a)[0], atol=1e-12)
        at += n


def _corpus():
    rng = np.random.default_rng(3)
    parts = {"xx": ["ta", "ke", "ro", "mi"], "yy": ["schu", "grä", "öl", "ung"], "zz": ["oux", "eau", "çe", "elle"]}
    word = lambda lang: "".join(rng.choice(parts[lang], rng.integers(1, 4)))
    return [(lang, " ".join(word(lang) for _ in range(40))) for lang in ("xx", "yy", "zz") * 30], word


def test_learns_and_finds_switches(spark):
    texts, word = _corpus()
    m = L.train(texts)
    fresh = [(k, lang, " ".join(word(lang) for _ in range(30))) for k, lang in enumerate(["xx", "yy", "zz"] * 20)]
    df = spark.createDataFrame(fresh, "doc_id long, lang string, text string")
    got = {r.doc_id: r for r in L.identify(df, m).collect()}
    assert sum(got[k].lang_pred == lang for k, lang, _ in fresh) >= 58 and all(0 <= r.score <= 1 for r in got.values())
    mixed = " ".join([word("xx") for _ in range(25)] + [word("zz") for _ in range(25)])
    odd = spark.createDataFrame([(1, mixed), (2, None), (3, " "), (4, "12 !!"), (None, word("yy") * 3)], "doc_id long, text string")
    out = {r.doc_id: r for r in L.identify(odd, m, runs=True).collect()}
    assert [r.lang for r in out[1].runs] == ["xx", "zz"] and abs(out[1].runs[1].start - 25) <= 1
    assert all((out[k].lang_pred, out[k].score) == ("und", 0.0) for k in (2, 3, 4)) and out[None].lang_pred == "yy"


def test_query_and_stage(spark, docs):
    assert L.learned_split(docs.limit(0)).count() == 0
    assert L.learned_split(docs).count() == docs.count()
    kept = L.keep_identified(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert 1 in ids and not ids & {r.doc_id for r in docs.where("text is null or text not rlike '[A-Za-z]'").collect() if r.doc_id and "é" not in (r.text or "")}


def test_without_labels_all_is_undetermined(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in L.learned_split(df).collect()] == ["und"]


def test_query_against_plain_chains(spark, docs, monkeypatch):
    """Predictions of the query as a chain over each whole text gives them, word by word, with the query's own model."""
    models, trained = [], L.train
    monkeypatch.setattr(L, "train", lambda texts: models.append(trained(texts)) or models[-1])
    got = sorted(L.learned_split(docs).collect(), key=str)
    (m,) = models
    want = []
    for i, text in sorted(((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=str):
        words = (text or "").encode().split()
        e, letters = np.exp(m.emissions([L.core(w) for w in words])), [bool(L.core(w)) for w in words]
        a, lang, score = np.exp(m.transitions), "und", 0.0
        if any(letters):
            forward, backward = [e[0] / e[0].sum()], [np.ones(len(a))]
            for x in e[1:]:
                forward.append((forward[-1] @ a) * x)
                forward[-1] = forward[-1] / forward[-1].sum()
            for x in e[:0:-1]:
                backward.append(a @ (backward[-1] * x))
                backward[-1] = backward[-1] / backward[-1].sum()
            each = [f * b / (f * b).sum() for f, b, own in zip(forward, backward[::-1], letters, strict=True) if own]
            mean = np.mean(each, axis=0)
            lang, score = m.languages[int(mean.argmax())], float(mean.max())
        want.append((i, i is not None and zlib.crc32(str(i).encode()) % 4 == 2, lang, round(score, 4)))
    assert sorted(((r.doc_id, r.held_out, r.lang_pred, round(r.score, 4)) for r in got), key=str) == sorted(want, key=str)


def test_features_of_many_words_are_those_of_each(monkeypatch):
    plain, other = [b"a", b"to", b"word", b"longer", b"x" * 300], [w.encode() for w in ("é", "été", "漢字", "naïveté", "𝒳y𝒳𝒳z")]
    want = {w: L.features(w) for w in plain + other}
    for words, ascii_only in ((plain, True), (other, False), (plain[:1], True), (other[:1], False)):
        flat, sizes = L.features_of(words, ascii_only)
        assert flat.tolist() == [x for w in words for x in want[w]] and sizes.tolist() == [len(want[w]) for w in words]
    monkeypatch.setattr(L, "features", lambda _: 1 / 0)  # words are rated all at once
    model = L.Model(["a", "b"], np.ones((L.WIDTH, 2)), {}, np.zeros((2, 2)), np.zeros((2, 2)))
    assert np.allclose(model.emissions([*plain, b"", *other])[:, 0], [len(want[w]) ** 0.5 for w in plain] + [0.0] + [len(want[w]) ** 0.5 for w in other])
