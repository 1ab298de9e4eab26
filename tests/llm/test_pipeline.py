import inspect
import zlib

import numpy as np
from test_decontaminate import brute as contamination
from test_neardup import brute as near_groups
from test_suffix_dedup import covered
from tokenizers import Tokenizer

import corpus_pipeline
from tracewell.llm import neardup
from tracewell.llm.common import components, tokenizer_path
from tracewell.llm.queries import ORACLE, QUERIES


def test_stages(spark, docs, tmp_path):
    own = docs.select("doc_id", "text", "lang", "source", "n_chars")
    own.write.parquet(str(tmp_path / "documents.parquet"))
    text = own.where("doc_id = 10").first().text
    spark.createDataFrame([(1, text)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "suffix_dedup", "decontamination", "packing"]
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    counts = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now.write.parquet(out := str(tmp_path / f"in{k}"))
        now = stage(spark, spark.read.parquet(out), str(tmp_path))
        if name != "packing":
            assert now.columns == own.columns and dict(now.dtypes) == dict(own.dtypes)
            counts.append(now.count())
        if name == "near_dedup":
            assert neardup.near_duplicates(now, 5, 80).where("not kept").count() == 0
    assert own.count() > counts[0] > counts[1] >= counts[2] > counts[3] > 0
    assert sum(r.length for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sum(r.length for r in now.collect()) > 0
    assert all(list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"] for _, f in corpus_pipeline.STAGES)


def test_against_brute_force(spark, docs, tmp_path):
    """The pieces of run() are those of texts that plain Python takes through all stages, in any order of sequences."""
    own = docs.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id is not null").distinct()
    own.write.parquet(str(tmp_path / "documents.parquet"))
    item = own.where("doc_id = 10").first().text
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    rows = sorted((r.doc_id, r.text) for r in own.collect() if any(c.isalpha() for c in r.text or ""))
    groups = near_groups(rows, 5, 80)
    rows = [(i, t) for i, t in rows if groups[i][2]]
    raw = [t.encode() for _, t in rows]
    gone = covered(raw, 200)
    assert any(g.any() for g in gone)
    rows = [(i, bytes(np.frombuffer(b, np.uint8)[~g]).decode("utf-8", "ignore")) for (i, _), b, g in zip(rows, raw, gone, strict=True)]
    hits = contamination(rows, [(1, item)])
    assert any(x[5] for x in hits)
    encoder = Tokenizer.from_file(tokenizer_path())
    want = {i: np.array([*encoder.encode(t, add_special_tokens=False).ids, 1], "<u4") for (i, t), x in zip(rows, hits, strict=True) if not x[5]}

    pieces, sequences = {}, {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(want)
    for i, ids in want.items():
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for each in sequences.values():
        each.sort()
        assert [o for o, _ in each] == [sum(n for _, n in each[:k]) for k in range(len(each))] and sum(n for _, n in each) <= 2048


def test_registered():
    assert sorted(QUERIES, key=lambda q: int(q[2:].split("_")[0])) == list(QUERIES) and len(QUERIES) == 13 and set(ORACLE) <= set(QUERIES)


def test_components(spark):
    pairs = [(k, k + 1) for k in range(1, 40)] + [(50, 60), (60, 55), (70, 70), (50, 60)] + [(100, k) for k in range(101, 160)]
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert got == {k: 1 for k in range(1, 41)} | {k: 50 for k in (50, 55, 60)} | {k: 100 for k in range(100, 160)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
