import hashlib
import re

from tracewell.llm import decontaminate


def brute(rows, items):
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of rows (doc_id, text), in their order."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    windows = {}
    for item, text in items:
        w = word.findall(low(text or ""))
        n = min(13, len(w))
        if w and item is not None:
            for k in range(len(w) - n + 1):
                windows.setdefault(tuple(w[k : k + n]), set()).add(item)
    out = []
    for i, t in rows:
        w, hit, met = word.findall(low(t)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    met |= own
                    hit |= set(range(k, k + n))
        out.append((i, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(map(str, met))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_against_brute_force(spark, docs, rows, texts):
    long = texts[9] if len(texts[9].split()) > 20 else texts[7]
    items = spark.createDataFrame([(1, texts[41]), (2, long.upper()), (3, "alpha1"), (4, None), (None, "beta2"), (5, "!!"), (6, texts[41]), (10, texts[41][20:300])], "item_id long, text string")
    want = brute(rows, [tuple(r) for r in items.collect()])
    found = decontaminate.decontaminate(docs, items)
    got = [tuple(r)[:6] for r in found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(x[5] for x in got) > 3
    clean = decontaminate.keep_clean(docs, items)
    assert clean.columns == docs.columns and clean.count() == sum(not x[5] for x in want)


def test_nothing_to_find(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs, none).where("contaminated").count() == 0
    assert decontaminate.decontaminate(docs.limit(0), none).count() == 0


def test_index_and_proximity(spark):
    df = spark.createDataFrame([(1, "a b c a, B x x c"), (2, None), (3, "c x x x b a")], "doc_id long, text string")
    index = {(r.term, r.doc_id): r.positions for r in decontaminate.build_index(df).collect()}
    assert index[("a", 1)] == [0, 3] and index[("b", 1)] == [1, 4] and ("a", 2) not in index
    q = spark.createDataFrame([(7, "C a b"), (8, ""), (9, "zzz")], "query_id long, text string")
    got = sorted(map(tuple, decontaminate.near_matches(df, q, 4).collect()))
    assert got == [(7, 1, 0, 3), (7, 1, 1, 4), (7, 1, 2, 5)]
    assert sorted(map(tuple, decontaminate.near_matches(df, q, 6).where("doc_id = 3").collect())) == [(7, 3, 0, 6)]
