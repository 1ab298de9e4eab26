import numpy as np
import pytest

from tracewell.llm import neardup, stages


def brute(rows, shingle, percent):
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t).split()
        n = min(shingle, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    low = {i: i for i in sets}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                low[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize(("shingle", "percent"), [(3, 85), (5, 80), (1, 30)])
def test_against_brute_force(docs, rows, shingle, percent):
    got = neardup.near_duplicates(docs, shingle, percent).collect()
    want = brute([(i, t) for i, t in rows if i is not None], shingle, percent)
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == want
    (null,) = [r for r in got if r.doc_id is None]
    assert null.component_id == want[6][1] and not null.kept


def test_rows_that_share_an_id_are_one_node(spark):
    text = lambda k: " ".join(f"{k}w{j}" for j in range(20))
    rows = [(9, text(1)), (9, text(2)), (3, text(1)), (12, text(2)), (5, text(2)), (7, text(4)), (8, None), (8, ""), (None, text(5)), (None, None)]
    got = sorted(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect(), key=str)
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(9, 3, False), (3, 3, True), (12, 3, False), (5, 3, False), (7, 7, True), (8, 8, True), (None, None, True)}
    assert len(got) == len(rows)


def test_sieve_keeps_all_of_its_ids(spark):
    df = spark.range(0, 4000).selectExpr("id - 1000 as doc_id", "cast(id as string) as text")
    bits = neardup.sieve(df.where("doc_id % 7 = 0"))
    got = {r.doc_id for r in neardup.sieved(df, bits).collect()}
    want = {k for k in range(-1000, 3000) if k % 7 == 0}
    assert want <= got and len(got) < len(want) + 20
    assert not neardup.sieved(df, neardup.sieve(df.limit(0))).count()


def test_empty_table(docs):
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_pruning_keeps_similar_pairs():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 62, 300, dtype=np.uint64)) for _ in range(2)]
    near = [np.concatenate([sets[0][:290], sets[1][:8]])]
    far = [np.concatenate([sets[0][:150], sets[1][:150]])]
    sig = neardup.signatures([sets[0], np.sort(near[0]), np.sort(far[0])], 144)
    alive = neardup.survivors(sig, sig, np.array([0, 0]), np.array([1, 2]), 0.85)
    assert alive.tolist() == [0]
    assert all(neardup.least_matches(0.85, n) < 0.85 * n for n in (24, 48, 144))
    assert (1 - 0.8 ** neardup.bands_for(0.8)[1]) ** neardup.bands_for(0.8)[0] < 1e-4


def test_a_group_of_near_copies_stays_together(spark):
    rng = np.random.default_rng(2)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(700):  # more than a block, with chains of links
        words = list(base)
        for p in rng.integers(0, 120, rng.integers(0, 12)):
            words[p] = f"e{k}_{p}"
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df, 3, 85).collect()}
    assert got == {i: c for i, (_, c, _) in brute(rows, 3, 85).items()}


def test_stage_keeps_one_of_each(docs):
    out = stages.one_of_each(docs)
    assert out.columns == docs.columns
    kept = [r.doc_id for r in out.select("doc_id").collect()]
    assert 6 in kept and 31 not in kept and 32 not in kept and None not in kept and kept.count(8) <= 1


def test_a_task_has_one_worker(docs, monkeypatch):
    """No step of near_duplicates() puts two passes of Python into one stage: idle workers of a task keep their memory."""

    def deepest(node, above=0):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return deepest(node.inputPlan(), above)
        own = 0 if "Exchange" in name else above + (name in ("MapInArrow", "FlatMapGroupsInPandas"))
        below = [node.children().apply(k) for k in range(node.children().size())]
        return max([own, *(deepest(x, own) for x in below)])

    found = {}

    def stash(df, name):
        found[name] = max(found.get(name, 0), deepest(df._jdf.queryExecution().executedPlan()))
        return kept(df, name)

    kept = neardup.stash
    monkeypatch.setattr(neardup, "stash", stash)
    neardup.near_duplicates(docs)
    assert found["texts"] == found["sets"] == 1 and max(found.values()) == 1
