"""Pattern packing of whole documents into sequences of a fixed capacity.

The plan is made on the histogram of lengths alone, so its size is bounded by
the capacity and not by the corpus: patterns of two or three lengths that fill a
sequence exactly are enumerated, non-negative least squares fits their repeat
counts to the histogram, the counts are rounded down, and what is left is packed
largest first, best fit, pattern by pattern. Documents then take their places by
their rank within their length.

Null text counts as empty. An empty document still has its closing id, so it is
one piece of length 1. Repeated rows and ids are packed row by row. A null id is
kept. An empty table gives no rows. Other input columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gapweave.llm.common import lean, slices, stage, table
from gapweave.llm.tokens import vocabulary, word_ids

CAPACITY = 2048
#: The least squares end when a round moves the counts by less than this share.
CLOSE, ROUNDS = 1e-4, 1000


def exact_patterns(h: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """All pairs and triples of lengths that fill a sequence; at most capacity squared / 12."""
    have = np.flatnonzero(h[:capacity])
    found = [(int(a), capacity - int(a)) for a in have if 2 * a >= capacity and h[capacity - a]]
    for a in have[::-1]:
        b = have[(have <= a) & (have < capacity - a) & (2 * have >= capacity - a)]
        b = b[h[capacity - a - b] > 0][::-1]
        found += [(int(a), int(x), int(capacity - a - x)) for x in b]
    return found


def nnls(patterns: list[tuple[int, ...]], h: np.ndarray) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - h|, by accelerated projected gradient until they stand still.

    A has a column for each pattern, with how often each length occurs in it. What
    convergence leaves open costs nothing but quality: counts are rounded down.
    """
    rows = np.array([v for p in patterns for v in p])
    cols = np.array([j for j, p in enumerate(patterns) for _ in p])
    fwd = lambda x: np.bincount(rows, x[cols], len(h))
    back = lambda r: np.bincount(cols, r[rows], len(patterns))
    v = np.ones(len(patterns))
    for _ in range(20):
        v = back(fwd(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(ROUNDS):
        new = np.maximum(0, y - back(fwd(y) - h) / (1.05 * norm))
        moved = np.linalg.norm(new - x)
        if (y - new) @ (new - x) > 0:  # overshot: start the acceleration anew
            t = 1.0
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, y, t = new, new + (t - 1) / t2 * (new - x), t2
        if moved <= CLOSE * max(1.0, np.linalg.norm(x)):
            break
    return x


def plan(h: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Places for h[v] pieces of each length v: rows (length, first rank, ranks, each, first sequence, offset).

    A row puts `each` neighbours in rank side by side into a sequence, from the offset on.
    """
    left, taken, rows, seq = h.astype(np.int64).copy(), np.zeros(len(h), np.int64), [], 0

    def place(lengths: dict[int, int], times: int) -> None:
        nonlocal seq
        offset = 0
        for v, each in lengths.items():
            rows.append((v, int(taken[v]), times * each, each, seq, offset))
            taken[v] += times * each
            left[v] -= times * each
            offset += v * each
        seq += times

    if left[capacity]:
        place({capacity: 1}, int(left[capacity]))
    patterns = exact_patterns(left, capacity)
    if patterns:
        counts = nnls(patterns, left.astype(float))
        for j in np.argsort(-counts, kind="stable"):
            if counts[j] + 1e-6 < 1:
                break
            lengths = {v: patterns[j].count(v) for v in patterns[j]}
            times = min(int(counts[j] + 1e-6), *(int(left[v]) // k for v, k in lengths.items()))
            if times > 0:
                place(lengths, times)
    present = np.flatnonzero(left[: capacity + 1])
    while len(present):
        room, lengths, upto = capacity, {}, len(present)
        while upto and room >= present[0]:
            upto = int(np.searchsorted(present[:upto], room, "right"))
            if not upto:
                break
            v = int(present[upto - 1])
            rest = room - v
            if lengths and rest and left[v] > 0:  # two that fill the room exactly go before the largest that fits
                twins = present[:upto][(present[:upto] * 2 > room)]
                twins = twins[left[room - twins] > 0] if len(twins) else twins
                twins = [int(u) for u in twins if int(u) not in lengths and int(room - u) not in lengths]
                if twins and left[room] == 0:
                    lengths |= {twins[-1]: 1, room - twins[-1]: 1}
                    room = 0
                    break
            k = min(int(left[v]), room // v)
            lengths[v] = k
            room -= k * v
            upto -= 1
        times = min(int(left[v]) // k for v, k in lengths.items())
        place(lengths, times)
        present = np.flatnonzero(left[: capacity + 1])
    return rows


def pieces(df: DataFrame, id_col: str, text_col: str, capacity: int, file: str, end_id: int) -> DataFrame:
    """One row per piece, with its task and its rank among the task's pieces of its length."""
    end = end_id.to_bytes(4, "little")
    typed = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        table, part, ranks = word_ids(file), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for some in (x for batch in batches for x in slices(batch)):
            out: list[tuple] = []
            for doc, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                ids = memoryview(table.text(text) + end)
                for i in range(0, len(ids), 4 * capacity):
                    piece = ids[i : i + 4 * capacity]
                    n = len(piece) // 4
                    out.append((doc, i // (4 * capacity), i // 4, n, zlib.crc32(piece), part, int(ranks[n])))
                    ranks[n] += 1
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return typed.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, part long, rank long")


def pack(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, file: str | None = None, end_id: int = 0
) -> DataFrame:
    """Packs every document; rows doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    `file` is the tokenizer's vocabulary; each document's ids end with `end_id`.
    """
    cut = stage(pieces(df, id_col, text_col, capacity, file or vocabulary(), end_id), "pieces")
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    h = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # capacity rows at most
        h[r.length] = r.n
    rows = sorted(plan(h, capacity))
    made = np.array(rows, np.int64).reshape(-1, 6)
    first = np.searchsorted(made[:, 0], np.arange(capacity + 2))
    span = int(h.max(initial=0)) + 1
    keys = made[:, 0] * span + made[:, 1] if (capacity + 1) * span < 2**62 else None

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            length, rank = x["length"].to_numpy(), x["rank"].to_numpy()
            if keys is not None:
                j = np.searchsorted(keys, length * span + rank, "right") - 1
            else:
                j = np.array([first[v] + np.searchsorted(made[first[v] : first[v + 1], 1], r, "right") - 1 for v, r in zip(length, rank, strict=True)])
            _, start, _, each, seq, offset = made[j].T
            at = rank - start
            yield x.drop(columns="rank").assign(sequence_id=seq + at // each, offset=offset + at % each * length)

    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = cut.join(before, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.coalesce("before", F.lit(0)) + F.col("rank")).alias("rank")
    )
    return ranked.mapInPandas(put, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
