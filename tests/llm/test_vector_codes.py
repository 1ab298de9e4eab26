import hashlib
import math
import random

import numpy as np
import pytest

from tracewell.llm import queries, vector_codes
from tracewell.llm.vector_codes import Codebook, codes_by_label, digest, encode

DATA = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, code string, hot long"


def brute(rows, parts=16, entries=64, rounds=2):
    """Codes, errors and codebooks of the contract, by comparing each part with each entry."""
    kept = [(i, [math.floor(256 * float(x)) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in kept[:entries]] for p in range(parts)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            members = {}
            for _, v, _ in kept:
                members.setdefault(near(p, cut(v)[p])[1], []).append(cut(v)[p])
            new.append([[sum(c) // len(c) for c in zip(*members[k])] if k in members else e for k, e in enumerate(books[p])])
        books = new
    out = []
    for i, v, lab in kept:
        best = [near(p, x) for p, x in enumerate(cut(v))]
        out.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), lab))
    totals = {}
    for _, _, e, lab in out:
        totals[lab] = totals.get(lab, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, totals[lab], sha) for i, c, e, lab in out), key=str)


def found(spark, rows):
    return sorted((tuple(r) for r in codes_by_label(spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA).repartition(3)).collect()), key=str)


def test_annulus_finds_the_nearest_entry_of_all():
    rng = np.random.default_rng(1)
    for spread in (1, 3, 90, 1 << 24):
        entries, x = rng.integers(-spread, spread + 1, (64, 4)), rng.integers(-spread, spread + 1, (3000, 4))
        entries[40] = entries[7]  # a tie
        at, far = Codebook(entries).nearest(x)
        d = ((x[:, None] - entries[None]) ** 2).sum(2)
        assert (at == d.argmin(1)).all() and (far == d.min(1)).all()
    at, far = Codebook(np.array([[0, 0]])).nearest(np.array([[3, 4], [0, 0]]))
    assert at.tolist() == [0, 0] and far.tolist() == [25, 0]


@pytest.mark.parametrize("n", [5, 64, 300])
def test_codes_equal_brute_force(spark, n):
    rng = random.Random(n)
    rows = [(k * 3 % n, [rng.gauss(0, 0.2) for _ in range(32)], rng.choice([1, 1, 2, None])) for k in range(n)]
    rows += [(n + 1, None, 1), (n + 2, [math.nan] + [0.0] * 31, 1), (n + 3, [None] + [0.0] * 31, 2), (n + 4, [math.inf] + [0.0] * 31, 2), (n + 5, [0.0] * 32, 7), rows[0], rows[1], (None, [0.5] * 32, 1)]
    rows = [(i, v and [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    assert found(spark, rows) == brute(rows)


def test_vectors_that_cannot_be_coded_stay_without_code(spark):
    plain = [0.25 * k for k in range(16)]
    rows = [(1, plain, 1), (2, [1.0] * 15, 1), (3, [1.0] * 32, 2), (4, [1e30] * 16, None), (5, [], 3), (6, None, 1)]
    got = {r[0]: r[1:4] for r in found(spark, rows)}
    assert got == {1: ("00" * 16, 0, 0), 2: (None, None, 0), 3: (None, None, None), 4: (None, None, None), 5: (None, None, None)}


def test_empty_tables_and_tables_without_vectors(spark):
    assert found(spark, []) == [] and found(spark, [(1, None, 1)]) == []
    assert [r[1] for r in found(spark, [(1, [1.0], 1)])] == [None]


def test_a_hot_label_and_equal_vectors(spark):
    rows = [(k, [0.1 * (k % 2)] * 16, 1) for k in range(2500)] + [(k, [0.3] * 16, k) for k in range(3000, 3050)]
    got = found(spark, rows)
    assert len(got) == len(rows) and {r[3] for r in got} == {r[3] for r in brute(rows[:64] + rows[2500:])}


def test_codebooks_are_returned(spark):
    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet")
    coded, books = encode(vectors, rounds=0)
    first = vectors.orderBy("vec_id").limit(64).collect()
    assert books.shape[:2] == (16, 64)
    assert books[0, 5].tolist() == [math.floor(256 * x) for x in first[5]["embedding"][: books.shape[2]]]
    assert len(digest(books)) == 64 and coded.where("vec_id = 3 and error = 0").count() == 1


def test_query_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM '{DATA}/embeddings.parquet'")
    want = con.execute(vector_codes.ORACLE).df()
    got = queries.op13_vector_codes(spark, DATA).toPandas()
    assert sorted(map(tuple, got[want.columns].values.tolist())) == sorted(map(tuple, want.values.tolist()))
