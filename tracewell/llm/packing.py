"""Documents packed into sequences of a fixed length, balanced by estimated training cost.

The cost of a piece of n tokens is linear plus quadratic: n / length + (n / length)^2, for the attention within it. In each
group, the number of sequences is the least that holds its tokens. Whole-length pieces of documents fill sequences of
their own; what remains of each document is taken in descending order and put into the sequence with the lowest cost
so far that still has room for all of it. A remainder that fits nowhere whole is cut between the cheapest sequences with
room. So all sequences but the group's last are full, and that one is instead one sequence for each binary digit of its
length: sequences whose lengths are powers of two need no padding.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import own_columns, remembered, shuffle_width
from tracewell.llm.tokens import crc32_ids, pack_ids, tokenize, unpack_ids

#: Bytes of text that make a group; a group is packed in one task.
GROUP_BYTES = 4 << 20
#: Bytes of text for which there is a task, at least as many as shuffles have.
TASK_BYTES = 64 << 20
#: sequence_id is the group times this plus the sequence's number in its group.
STRIDE = 1 << 24
#: The attention's weight against the linear part for a piece of full length.
QUADRATIC = 1.0


def cost(n: int, length: int, quadratic: float = QUADRATIC) -> float:
    x = n / length
    return x + quadratic * x * x


def pack_lengths(lengths: list[int], length: int, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, n, sequence, offset) of documents of the given lengths; each token in exactly one."""
    pieces: list[tuple[int, int, int, int, int]] = []
    rest: list[tuple[int, int]] = []
    sequence = 0
    for doc, n in enumerate(lengths):
        full = n // length
        for k in range(full):
            pieces.append((doc, k * length, length, sequence, 0))
            sequence += 1
        if n % length:
            rest.append((n % length, doc))
    total = sum(n for n, _ in rest)
    sizes = [length] * (total // length)
    tail = total % length  # its binary digits are lengths that need no padding
    sizes += [1 << k for k in range(length.bit_length() - 1, -1, -1) if tail >> k & 1]
    sizes = np.array(sizes, dtype=np.int64)
    room, spent = sizes.copy(), np.zeros(len(sizes))
    for n, doc in sorted(rest, key=lambda x: (-x[0], x[1])):
        start = lengths[doc] - n
        while n:
            fits = room >= n
            if not fits.any():
                fits = room > 0  # it must be cut: the cheapest sequence with any room takes what it can
            k = int(np.where(fits, spent, np.inf).argmin())
            m = min(n, int(room[k]))
            pieces.append((doc, start, m, sequence + k, int(sizes[k] - room[k])))
            room[k] -= m
            spent[k] += cost(m, length, quadratic)
            start, n = start + m, n - m
    return pieces


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, quadratic: float = QUADRATIC) -> DataFrame:
    """Pieces of all documents (doc_id, text), each with its ids.

    start is the number of the document's ids before the piece; offset is the piece's place in its sequence. A null or
    empty text is a document of the end id alone. Rows with the same doc_id are documents of their own; null ids are
    kept; other columns aren't read; an empty table gives no pieces.

    Rows are dealt to groups of about GROUP_BYTES of text by a hash of id and place, so neither one source nor one
    repeated id makes a group large. Ids travel compressed, once; a group's task holds only its own.
    """
    docs = own_columns(docs, "doc_id", "text")
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0
    groups = max(1, -(-size // GROUP_BYTES))
    rows = tokenize(docs, tokenizer, end_id).withColumn("grp", F.pmod(F.xxhash64("doc_id", "salt"), F.lit(groups)))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        squeeze = remembered("packing", lambda: zstandard.ZstdCompressor(level=1))  # in place of what tokenizing knew
        pdf = pdf.sort_values(["doc_id", "salt", "ids_crc32"], kind="stable").reset_index(drop=True)
        out = []
        lengths = pdf["n_tokens"].tolist()
        whole: dict[int, np.ndarray] = {}
        for doc, start, n, sequence, offset in sorted(pack_lengths(lengths, length, quadratic)):
            if doc not in whole:
                whole = {doc: unpack_ids(pdf["ids"].iat[doc])}
            ids = whole[doc][start : start + n]
            out.append((start, n, crc32_ids(ids), lengths[doc], int(key[0]) * STRIDE + sequence, offset, pack_ids(ids, squeeze), doc))
        made = pd.DataFrame(out, columns=["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "doc"])
        made.insert(0, "doc_id", pdf["doc_id"].astype("Int64").take(made.pop("doc")).reset_index(drop=True))
        return made

    # Tasks have about TASK_BYTES of text; more of them, not larger ones, as the table grows.
    tasks = max(shuffle_width(docs.sparkSession), -(-size // TASK_BYTES))
    return rows.repartition(tasks, "grp").groupBy("grp").applyInPandas(run, PIECES)
