import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tracewell.llm import collocations, queries
from tracewell.llm.collocations import names_of, passes, phrase_hashes, phrases, sieve_of, word_hashes


def brute(rows, longest=5, least=100, most=2000, percent=100):
    """The contract's rows, by counting everything."""
    f = defaultdict(Counter)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            w = re.findall("[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                f["und" if lang is None else lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        n = sum(c for p, c in counts.items() if len(p) == 1)
        some = {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        best = []
        for p, a in some.items():
            longer = [q for q, c in some.items() if len(q) > len(p) and 100 * c >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not longer:
                score, k = min((1000 * a * n // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, j + 1, p.decode(), -a, left, r, n, -s) for j, (s, a, p, left, r) in enumerate(sorted(best)[:most])]
    return sorted(out)


def test_phrases_equal_brute_force(spark, docs):
    rows = [(r.lang, r.text) for r in docs.collect()]
    for least, most, percent in ((2, 2000, 100), (2, 7, 60)):
        got = sorted(tuple(r) for r in phrases(docs, least=least, most=most, percent=percent).collect())
        assert got == brute(rows, least=least, most=most, percent=percent) and len(got) > 5


def test_pieces_words_overlaps_and_ties(spark):
    rows = [("en", "A b. a B, a\tb;a b\x0bA B"), ("en", "x x x x x x"), (None, "p q r  p q r"), ("en", None), ("en", ""), ("en", " .,; "), ("fr", "É é É é"), ("en", "c d\nc d\r\nc d")]
    df = spark.createDataFrame(rows, "lang string, text string")
    got = sorted(tuple(r) for r in phrases(df, least=2).collect())
    assert got == brute(rows, least=2)
    assert ("en", "x x x x x") in {(r[0], r[2]) for r in got} and ("und", "p q r") in {(r[0], r[2]) for r in got}


def test_a_hot_language_and_common_phrases_over_many_chunks(spark, monkeypatch):
    rows = [("en", f"of the w{k % 3} of the rest") for k in range(900)] + [("de", "der eine") for _ in range(40)] + [("en", "of the " * 3000)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    monkeypatch.setattr(collocations, "CHUNK", 2000)
    assert sorted(tuple(r) for r in phrases(df, least=30).collect()) == brute(rows, least=30)


def test_a_full_sieve_changes_nothing(spark, monkeypatch, docs):
    want = sorted(map(tuple, phrases(docs, least=2).collect()))
    monkeypatch.setattr(collocations, "LEAST", 64)
    monkeypatch.setattr(collocations, "MOST", 64)
    monkeypatch.setattr(collocations, "COUNTERS", 16)
    monkeypatch.setattr(collocations, "SHARE", 100)
    assert sorted(map(tuple, phrases(docs, least=2).collect())) == want


def test_the_sieve_holds_all_of_its_phrases(spark):
    rows = [("en", f"w{k} v{k}".encode()) for k in range(500)]
    sieve = sieve_of(names_of(spark.createDataFrame(rows, "lang string, phrase binary"), 2))
    h = phrase_hashes(collocations.language_hash("en"), [word_hashes([f"{x}{k}".encode() for k in range(500)]) for x in "wv"])
    other = phrase_hashes(collocations.language_hash("fr"), [word_hashes([f"{x}{k}".encode() for k in range(500)]) for x in "wv"])
    assert passes(sieve, h).all() and passes(sieve, other).mean() < 0.01


def test_products_beyond_64_bits(spark, monkeypatch):
    """Counts of thousands of billions, put in where words are counted."""
    monkeypatch.setattr(collocations, "_counted", lambda rows: rows.groupBy("lang", "phrase").agg(collocations.F.sum(collocations.F.col("n") * 1_000_000_000_000).alias("a")))
    monkeypatch.setattr(collocations, "frequent_counters", lambda runs, length, parts, shards, least, real=collocations.frequent_counters: real(runs, length, parts, shards, 1))
    df = spark.createDataFrame([("en", "a b c a b b a b")], "lang string, text string")
    got = {r.phrase: r for r in phrases(df, least=3_000_000_000_000).collect()}
    assert got["a b"].score == 1000 * 3 * 8 // (3 * 4) and got["a b"].a == 3 * 10**12


@pytest.mark.parametrize("rows", [[], [("en", None)], [(None, "one")]])
def test_nothing_to_find(spark, rows):
    assert phrases(spark.createDataFrame(rows, "lang string, text string")).collect() == []


def test_query_equals_sql(spark, tmp_path):
    import duckdb

    docs = spark.createDataFrame([("en", f"The cat sat, the dog ran {k % 7} miles. On the cat sat!") for k in range(150)] + [(None, "a b c " * 60)], "lang string, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(collocations.ORACLE).df()
    got = queries.op11_collocations(spark, str(tmp_path)).toPandas()
    assert len(want) and sorted(map(tuple, got[want.columns].values.tolist())) == sorted(map(tuple, want.values.tolist()))


def test_a_sieve_needs_no_worker_beside_that_of_its_names(spark, monkeypatch):
    rows = [("en" if k % 2 else "fr", f"w{k} x{k}".encode()) for k in range(3000)]
    names = names_of(spark.createDataFrame(rows, "lang string, phrase binary"), 2)
    h = np.array([r.name for r in names.collect()]).view(np.uint64)

    def second(*_):
        raise AssertionError("two steps in Python in one task leave two workers in its executor")

    monkeypatch.setattr(type(names), "mapInArrow", second)
    sieve = sieve_of(names)
    want = np.zeros(len(sieve) * 8, bool)
    want[np.concatenate([h & np.uint64(len(want) - 1), h >> np.uint64(32) & np.uint64(len(want) - 1)]).astype(np.int64)] = True
    assert (np.unpackbits(sieve, bitorder="little") == want).all()
