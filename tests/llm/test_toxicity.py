import math
import random
import zlib

import numpy as np
import pytest

from tracewell.llm import queries, toxicity
from tracewell.llm.toxicity import Index, Scale, Vocabulary, learned_split, score, terms_of, train, weights, words

DATA = "/root/testdata/sf0.01"


def examples(rng, n, terms):
    out = []
    for _ in range(n):
        at = np.array(sorted(rng.sample(range(terms), rng.choice([1, 2, 5]))), np.int64)
        w = np.array([rng.choice([1.0, 1.0, 2.5]) for _ in at])
        out.append((at, w / np.sqrt((w * w).sum())))
    return out


def test_neighbours_are_those_of_all_cosines():
    rng = random.Random(4)
    for n, terms in ((1, 6), (63, 9), (700, 40)):
        vectors = examples(rng, n, terms)
        index = Index(vectors, np.array([rng.randrange(2) for _ in range(n)]), np.arange(n), terms)
        at_place = [vectors[i] for i in index.ids.tolist()]
        for at, w in examples(rng, 60, terms):
            for without in (-1, 0):
                q = np.zeros(terms)
                q[at] = w
                cos = [0.0 if k == without else min(1.0, float(sum(q[t] * x for t, x in zip(*v)))) for k, v in enumerate(at_place)]
                want = sorted((-round(c, 9), k) for k, c in enumerate(cos) if c > 0)[: toxicity.NEIGHBOURS]
                places, cosines = index.nearest(at, w, without=without)
                assert [round(c, 9) for c in cosines.tolist()] == [-c for c, _ in want]
                # Places of equal cosines may be told apart by the last digit.
                assert len(set(places.tolist())) == len(places) and all(abs(cos[p] - c) < 1e-9 for p, c in zip(places.tolist(), cosines.tolist()))


def test_terms_words_and_weights():
    assert words("It's  Überall-ÄB 12 x".encode()) == ["it".encode(), b"s", "Überall".encode(), "Äb".encode(), b"x"]
    assert terms_of("straße".encode()) == ["straße", "stra*", "straß*"] and terms_of(b"cat") == ["cat"]
    v = Vocabulary(["badn*", "badly", "stra*"])
    assert v.counts(b"badly badness good") == {0: 1, 1: 1, 3: 1}
    assert v.counts(b"nothing here") == {} and v.counts(b"") == {}
    at, w = weights({0: 3, 1: 1}, np.array([2.0, 1.0]))
    assert at.tolist() == [0, 1] and math.isclose(w[0] / w[1], 2 * (1 + math.log(3)))


def test_scale_is_monotone_and_keeps_the_rate():
    votes = [0.0, 0.1, 0.1, 0.9, 1.0, 0.2, 1.0, None, None]
    y = np.array([0, 0, 1, 1, 1, 0, 1, 0, 0])
    s = Scale(votes, y, 0.1)
    at = [s.of(v) for v in np.linspace(0, 1, 21)]
    assert all(a <= b for a, b in zip(at, at[1:])) and all(0 <= a <= 1 for a in at) and 0 <= s.without < 0.2
    assert Scale([None, None], np.array([0, 1]), 0.5).of(0.7) == Scale([None, None], np.array([0, 1]), 0.5).without


def corpus(n=400):
    rng = random.Random(9)
    plain = [f"{a}{b}" for a in ("mo", "ta", "ri", "ke", "su") for b in ("lan", "dor", "vik", "nel")]
    rows, labels = [], []
    for k in range(n):
        w = [rng.choice(plain) for _ in range(rng.choice([3, 30, 200]))]
        bad = k % 8 == 0
        for _ in range(3 if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["fiend", "wretch", "vermin"]) + rng.choice(["", "s", "ish"]))
        rows.append((k, " ".join(w)))
        labels.append((k, int(bad)))
    return rows, labels


def test_held_out_documents_of_a_small_corpus(spark):
    rows, labels = corpus()
    got = learned_split(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    label = dict(labels)
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        assert r.predicted == label[r.doc_id]
        assert not r.predicted or (r.terms and r.neighbours and r.neighbours[0]["cosine"] >= r.neighbours[-1]["cosine"])
    learned = {n["doc_id"] for r in got for n in r.neighbours}
    assert all(zlib.crc32(str(i).encode()) % 4 != 2 for i in learned)


def test_nulls_repeats_missing_and_odd_labels(spark, docs):
    rows, labels = corpus(200)
    extra = [(None, rows[0][1]), (0, rows[0][1]), (1000, None), (1001, ""), (1002, "vermins " * 20000), (1003, "..."), (2, "another text of the same document")]
    d = spark.createDataFrame([(*r, 0.5, "x") for r in rows + extra], "doc_id long, text string, score double, terms string").repartition(3)
    lab = spark.createDataFrame(labels + [(None, 1), (5, None), (8, 1), (8, 1), (8, 0), (7777, 1)], "doc_id long, toxic int")
    got = score(d, train(d, lab)).collect()
    assert len(got) == len(rows) + len(extra)
    by = {r.doc_id: r for r in got}
    assert by[1002].predicted == 1 and by[1000].score == by[1001].score == by[1003].score < 0.3
    assert [r.predicted for r in got if r.doc_id is None] == [1]
    assert len(score(docs, train(d, lab)).collect()) == docs.count()


def test_without_labels_documents_or_sides(spark):
    rows, labels = corpus(40)
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    none = lab.where("false")
    assert {(r.score, r.predicted) for r in learned_split(d, none).collect()} == {(0.0, 0)}
    assert learned_split(d.where("false"), lab).collect() == []
    assert {r.predicted for r in score(d, train(d, lab.where("toxic = 0"))).collect()} == {0}
    assert {r.predicted for r in score(d, train(d, lab.where("toxic = 1"))).collect()} == {1}


def test_sample_is_bounded_and_deterministic(spark):
    rows, labels = corpus(300)
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    m = train(d, lab, toxic=20, clean=30)
    again = train(d.repartition(5), lab.repartition(3), toxic=20, clean=30)
    assert m.index.n <= 50 and m.index.ids.tolist() == again.index.ids.tolist() and m.terms == again.terms


def test_query_on_held_out_labels(spark):
    got = {r.doc_id: r for r in queries.op12_toxicity(spark, DATA).collect()}
    truth = spark.read.parquet(f"{DATA}/labels.parquet").join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").where("lang = 'en'").collect()
    held = [(got[r.doc_id].predicted, r.toxic) for r in truth if got[r.doc_id].held_out]
    assert len(held) > 40 and sum(a == b for a, b in held) / len(held) > 0.97 and any(a for a, _ in held)


@pytest.mark.parametrize("text", ["It's a test", "", "ÄÖ ü"])
def test_no_model_scores_nothing(text):
    assert toxicity.Model([], np.zeros(0), None, None).score(text.encode(), Vocabulary([])) == (0.0, [], [])
