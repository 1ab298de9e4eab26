import hashlib
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from tracewell.llm import stages, suffix_dedup
from tracewell.llm.common import SHUFFLE_CLEANUP, scratch_tables


def covered(texts, length):
    """Which bytes of each text lie in a string of that length which starts elsewhere, too."""
    seen = Counter(b[k : k + length] for b in texts for k in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k] += 1
                gone[k + length] -= 1
        out.append(np.cumsum(gone)[:-1] > 0)
    return out


def brute(texts, length):
    out = []
    for b, gone in zip(texts, covered(texts, length), strict=True):
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length", [200, 50])
def test_against_brute_force(docs, rows, length):
    got = [tuple(r)[:6] for r in suffix_dedup.remove_repeats(docs, length).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    want = [(i, *x) for (i, _), x in zip(rows, brute([t.encode() for _, t in rows], length), strict=True)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(x[2] for x in got) > 1000


def test_empty_table(docs):
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_refinement_names_equal_bytes_alike():
    data = b"abcdefghij" * 60
    b = suffix_dedup.Buckets(data, 100)
    x, y = b.strings(np.arange(len(data) - 99))
    assert len({*zip(x.tolist(), y.tolist(), strict=True)}) == 10


def test_stage_keeps_columns(docs):
    out = stages.without_repeats(docs)
    assert out.columns == docs.columns
    kept = {r.doc_id: r.text for r in out.collect()}
    assert all("�" not in (t or "") for t in kept.values()) and kept[1] == docs.where("doc_id = 1").first().text


def test_stage_keeps_emptied_rows(spark):
    passage = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(230))
    rows = [(1, passage, 230), (2, "before it " + passage + " behind it", 250), (3, "alone", 5), (4, None, None), (5, "", 0)]
    out = stages.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect()
    got = {r.doc_id: (r.text, r.n_chars) for r in out}
    assert got == {1: ("", 0), 2: ("before it  behind it", 20), 3: ("alone", 5), 4: (None, None), 5: ("", 0)}


def test_tables_and_shuffles_go_when_read(spark, docs):
    """Tables and shuffle files of earlier steps don't add up to the disk of later ones."""
    dirs = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    shuffled = lambda: {p for d in dirs for p in Path(d).glob("*/shuffle_*.data")}
    before, tables = shuffled(), len(scratch_tables())
    suffix_dedup.remove_repeats(docs, 50)
    names = [t._scratch.rsplit("/", 1)[1].split("-")[0] for t in scratch_tables()[tables:]]
    assert sorted(names) == ["strings", "texts", "twice", "whole", "whole"]
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before and spark.conf.get(SHUFFLE_CLEANUP) == "false"
