import numpy as np

from tracewell.llm import quality as Q


def test_estimation_finds_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20000) < 0.8
    right = [0.95, 0.9, 0.7]
    votes = np.array([np.where(rng.random(20000) < 0.5, np.where(rng.random(20000) < a, 1, -1) * np.where(truth, 1, -1), 0) for a in right]).T
    counts = {}
    for p in Q.vote_text(votes):
        counts[p] = counts.get(p, 0) + 1
    posterior, accuracy, prior = Q.estimate(counts)
    assert np.allclose(accuracy, right, atol=0.04) and abs(prior - 0.8) < 0.04
    assert posterior["+++"] > 0.99 > 0.3 > posterior["---"]


def test_judges(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 8)))
    make = {
        1: lambda: ". ".join(" ".join(word() for _ in range(9)) for _ in range(6)).capitalize() + ".",
        2: lambda: " ".join(word().upper() + "!!" for _ in range(60)),
        3: lambda: " | ".join(word() for _ in range(60)),
        4: lambda: " ".join(word() + "%%%" for _ in range(60)),
        5: lambda: " ".join(w for w in [word() for _ in range(4)] for _ in range(20)),
    }
    rows = [(k, make[1]() if k % 5 else make[2 + k // 5 % 4](), "x") for k in range(600)]
    df = spark.createDataFrame([*rows, (1000, None, ""), (1001, "", ""), (None, make[1](), "")], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in Q.classify(df).collect()}
    good = [got[k].keep for k in range(600) if k % 5]
    bad = [got[k].keep for k in range(600) if not k % 5]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.05
    assert (got[1000].keep, got[1000].score, got[1000].weak_good) == (False, 0.0, None) and got[None].keep
    assert Q.classify(df.limit(0)).count() == 0


def test_every_row_by_itself(docs):
    """Nulls, repeated rows and ids, empty and long texts, clashing columns: each row has what its own text gives."""
    posterior, _, prior, weights = Q.weak_model(docs)
    got = sorted(((r.doc_id, r.n_words, r.votes, r.weak_good, round(r.score, 9), r.keep) for r in Q.classify(docs).collect()), key=str)
    want = []
    for r in docs.select("doc_id", "text").collect():
        n, votes, features, _ = Q.examine([(r.text or "").encode()], Q.Words())
        told, n = Q.vote_text(votes)[0], int(n[0])
        z = sum(weights[f] for f in features) / (n + Q.DAMPING) + weights[-1]
        score = 1 / (1 + np.exp(-z)) if n else 0.0
        want.append((r.doc_id, n, told, posterior[told] if n else None, round(float(score), 9), bool(n and score >= 0.5)))
    assert got == sorted(want, key=str) and 0 < prior < 1
    assert sum(x[1] == 0 for x in got) >= 3


def test_shared_ids_are_drawn_once(spark):
    text = "a word and another one, "
    df = spark.createDataFrame([(1, text * (k % 5 + 1)) for k in range(300)] + [(k, "!!! ??? ### " * 9) for k in range(2, 12)], "doc_id long, text string")
    found, fit = [], Q.fit
    Q.fit = lambda rows, *a: found.append(len(rows)) or fit(rows, *a)
    try:
        assert Q.classify(df, sample=4).count() == 310
    finally:
        Q.fit = fit
    assert found[0] <= 8


def test_estimate_and_fit_do_with_ties_and_nothing():
    posterior, accuracy, prior = Q.estimate({"+-": 5, "-+": 5, "..": 1})
    assert abs(posterior["+-"] - posterior["-+"]) < 1e-9 and accuracy[0] == accuracy[1] and 0 < prior < 1
    assert not Q.fit([]).any()


def test_missing_and_shared_ids_train_all_the_same(spark):
    good = [f"The {a} of a {b} was seen by them, and all {c} went on with it in the end, while others who had come by boat that week stayed near our old mill until rain fell over every hill around." for a in ("house", "river", "road", "field") for b in ("man", "child", "friend") for c in ("day", "night")]
    junk = [f"BUY {a}!!! NOW!!! {b}!!! $$$ ### WIN!!! WIN!!! WIN!!!" for a in ("GOLD", "CARS", "LAND") for b in ("FREE", "CHEAP", "FAST")]
    texts = good * 3 + junk * 2
    for ids in ([None] * len(texts), [7] * len(texts)):
        got = Q.classify(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")).collect()
        scores = sorted(r.score for r in got)
        assert len(got) == len(texts) and sum(r.keep for r in got) == len(good) * 3 and scores[0] < 0.3 < 0.7 < scores[-1]


def test_votes_need_nothing_of_the_scorer_and_shapes_are_told_at_once(monkeypatch):
    texts = [t.encode() for t in ("Plain words a b !! CAPS ÉTÉ naïve 漢字漢字 | ## 12345 ²² aaa---bbb", "", "x " * 40, "\x00\x00\x00 !!! ǅǅǅ")]
    whole = Q.examine(texts, Q.Words())
    monkeypatch.setattr(Q, "shape", lambda _: 1 / 0)
    n, votes, features, owner = Q.examine(texts, Q.Words(scored=False))
    assert (n == whole[0]).all() and (votes == whole[1]).all() and not len(features) and not len(owner)
    monkeypatch.undo()

    def plainly(word):
        out = []
        for c in word.decode("utf-8", "replace"):
            k = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
            if out[-2:] != [k, k]:
                out.append(k)
        return "".join(out)[:12].encode()

    words = [w for t in texts for w in t.split()] + [b"ab\xff\xff\xffC", "ⅷⅷⅷ99".encode()]
    assert [Q.shape(w) for w in words] == [plainly(w) for w in words]
