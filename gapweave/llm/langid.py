"""Language identification by interpolated Kneser-Ney character models, one per language.

Words are runs of letters in lower case, led by three start marks and closed by an
end mark; each character is predicted from the three before it. Four characters
pack into one 64-bit key; a language's model is, for each order, a sorted array of
keys with log probabilities and back-off weights. A block's distinct 4-grams are
looked up once. The language of the lowest cross-entropy per character wins; a
text whose cross-entropy exceeds what its language showed on calibration rows by
REJECT deviations is marked as rejected. The score weighs the best language against
the others and against that bound: in the language's deviations, over a temperature
that makes the mean score of calibration rows their accuracy. So it is below 1/2
where a text is rejected, and falls with every deviation from the usual.

Models are trained on TRAIN_ROWS labelled rows per language, calibration takes as
many others, every second one of the permitted rows in the order of a hash, so a
rare language trains first and the sample is the same on any cluster. Null texts and texts without a letter get `und` and score 0. Rows without
a label train nothing; without any label all rows get `und`. A null id is never
held out and never trains. Repeated rows are judged row by row; a hot label adds
no rows beyond the bound, nor do repeated ids. Other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gapweave.llm.common import lean, slices, stage, table

#: Bound on the labelled rows of a language that train its model, and on those that calibrate it.
TRAIN_ROWS = 400
ORDER = 4
START, END = 1, 2
LETTERS = regex.compile(r"\p{L}+")
#: Code points of text whose distinct words are in memory at once.
BLOCK = 8_000_000
#: Characters from which on a calibration row tells the usual cross-entropy of its language.
SURE = 64
#: A text is rejected beyond its language's mean cross-entropy by so many standard deviations.
REJECT = 6.0


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The packed 4-grams of the words, and where each word's begin."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    # beyond the first plane: 2,048 classes, at code points that no text has
    codes = np.where(codes > 0xFFFF, 0xD800 + (codes & np.uint64(0x7FF)), np.where(codes <= END, 0xFFFD, codes))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 4)
    padded = np.full(int(ends[-1]) if len(ends) else 0, START, np.uint64)
    at = np.arange(len(codes)) + np.repeat(np.arange(1, len(words) + 1) * 3 + np.arange(len(words)), sizes)
    padded[at] = codes
    padded[ends - 1] = END
    key = padded.copy()
    for back in (1, 2, 3):
        key[back:] |= padded[:-back] << np.uint64(16 * back)
    own = np.ones(len(padded), bool)
    begin = ends - sizes - 4
    for k in range(3):
        own[begin + k] = False
    return key[own], np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) if len(words) else np.zeros(0, np.int64)


class Model:
    """One language: for orders 4 to 1 sorted keys, log probabilities; for contexts, log back-off weights."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        keys, counts = keys[order].astype(np.uint64), counts[order].astype(float)
        tables = [(keys, counts)]  # of order 4, then of 3, 2, 1 with continuation counts
        for n in (3, 2, 1):
            kinds, times = np.unique(tables[-1][0] & np.uint64((1 << 16 * n) - 1), return_counts=True)
            tables.append((kinds, times.astype(float)))
        n_kinds = len(tables[-1][0])
        lower_keys, lower = np.zeros(1, np.uint64), np.full(1, 1.0 / (n_kinds + 1))
        self.orders: list[tuple] = []
        for n, (k, c) in zip((1, 2, 3, 4), reversed(tables), strict=True):
            ones, twos = (c == 1).sum(), (c == 2).sum()
            d = ones / (ones + 2 * twos) if ones and twos else 0.5
            context = k >> np.uint64(16)
            contexts, at, kinds = np.unique(context, return_inverse=True, return_counts=True)
            total = np.bincount(at, c, len(contexts))
            weight = d * kinds / total
            shorter = k & np.uint64((1 << 16 * (n - 1)) - 1)
            p = (c - d) / total[at] + weight[at] * lower[np.searchsorted(lower_keys, shorter)]
            self.orders.append((k, np.log(p), contexts, np.log(weight)))
            lower_keys, lower = k, p
        self.unknown = float(np.log(1.0 / (n_kinds + 1)))

    def log_p(self, key: np.ndarray) -> np.ndarray:
        """Log probability of the last character of each packed 4-gram."""
        out = np.full(len(key), self.unknown)
        for n, (k, p, contexts, weight) in enumerate(self.orders, 1):
            sub = key & np.uint64((1 << 16 * n) - 1) if n < 4 else key
            at = np.minimum(np.searchsorted(k, sub), len(k) - 1)
            seen = k[at] == sub
            c = sub >> np.uint64(16)
            ctx = np.minimum(np.searchsorted(contexts, c), len(contexts) - 1)
            out = np.where(seen, p[at], out + np.where(contexts[ctx] == c, weight[ctx], 0.0))
        return out


def entropies(texts: list[str | None], models: list[Model]) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy per character of each text under each model, and its characters, end marks included."""
    index: dict[str, int] = {}
    found = [np.fromiter((index.setdefault(w, len(index)) for w in LETTERS.findall((t or "").lower())), np.int64) for t in texts]
    chars, out = np.zeros(len(texts)), np.zeros((len(texts), len(models)))
    if not index:
        return out, chars
    keys, starts = grams(list(index))
    kinds, at = np.unique(keys, return_inverse=True)
    sizes = np.diff(np.append(starts, len(keys)))
    doc = np.repeat(np.arange(len(texts)), [len(f) for f in found])
    word = np.concatenate(found)
    chars = np.bincount(doc, sizes[word], len(texts))
    for j, m in enumerate(models):
        by_word = np.add.reduceat(m.log_p(kinds)[at], starts)
        out[:, j] = -np.bincount(doc, by_word[word], len(texts)) / np.maximum(chars, 1)
    return out, chars


def fold(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 3


def sample(df: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """Rows (label, text, own): at most `rows` labelled rows of each language that train (own 0) and as many that calibrate (1)."""
    typed = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(text_col).cast("string").alias("text"))
    typed = typed.filter(F.col("label").isNotNull() & F.col("text").isNotNull() & (fold("id") != 1)).withColumn("t", F.xxhash64("text"))
    keys = typed.select("id", "label", "t", F.xxhash64("id", "t").alias("h")).distinct()
    # ranked within parts of a label first, so a hot label is many groups
    parts = keys.withColumn("part", F.pmod("h", F.lit(32)))
    few_ = parts.withColumn("k", F.row_number().over(Window.partitionBy("label", "part").orderBy("h", "id"))).filter(F.col("k") <= 2 * rows)
    ranked = few_.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("h", "id"))).filter(F.col("k") <= 2 * rows)
    ranked = ranked.select("id", "label", "t", ((F.col("k") - 1) % 2).alias("own"))
    return typed.join(F.broadcast(ranked), ["id", "label", "t"]).groupBy("id", "label", "t", "own").agg(F.first("text").alias("text"))  # 2 * rows a language


def scores(h: np.ndarray, usual: np.ndarray, heat: float) -> tuple[np.ndarray, np.ndarray]:
    """For each text the best language and its score. usual: each language's mean and deviation of cross-entropy."""
    best = h.argmin(axis=1)
    at = np.arange(len(h))
    mean, dev = usual[best].T
    others = -(h - h[at, best][:, None]) / (dev * heat)[:, None]
    bound = (h[at, best] - (mean + REJECT * dev)) / (dev * heat)
    return best, 1 / (np.exp(np.minimum(others, 0)).sum(axis=1) + np.exp(np.minimum(bound, 700)))


def temperature(h: np.ndarray, own: np.ndarray, usual: np.ndarray) -> float:
    """The heat at which the mean score of calibration rows is their accuracy."""
    if not len(h):
        return 1.0
    right = ((h.argmin(axis=1) == own).sum() + 0.5) / (len(h) + 1)
    low, high = 1e-3, 1e3
    for _ in range(60):
        mid = (low * high) ** 0.5
        low, high = (mid, high) if scores(h, usual, mid)[1].mean() > right else (low, mid)
    return (low * high) ** 0.5


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", rows: int = TRAIN_ROWS) -> tuple[list[str], list[Model], np.ndarray, float]:
    """Languages, their models, for each the mean and deviation of calibration rows, and the temperature of scores."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            for label, texts in x.groupby("label")["text"]:
                words = [w for t in texts for w in LETTERS.findall(t.lower())]
                if words:
                    k, n = np.unique(grams(words)[0], return_counts=True)
                    yield pd.DataFrame({"label": label, "gram": k.view(np.int64), "n": n})

    chosen = stage(sample(df, id_col, text_col, label_col, rows), "sample")
    counted = chosen.filter("own = 0").select("label", "text").mapInPandas(count, "label string, gram long, n long")
    got = counted.groupBy("label", "gram").agg(F.sum("n").alias("n")).toPandas()  # the kinds of 4-gram in a bounded sample
    langs = sorted(got["label"].unique().tolist())
    models = [Model(g["gram"].to_numpy(np.int64).view(np.uint64), g["n"].to_numpy()) for _, g in ((v, got[got["label"] == v]) for v in langs)]
    if not langs:
        return [], [], np.zeros((0, 2)), 1.0

    def calibrate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            h, chars = entropies(x["text"].tolist(), models)
            own = x["label"].map({v: j for j, v in enumerate(langs)})
            ok = own.notna().to_numpy() & (chars > 0)
            yield pd.DataFrame({"own": own[ok].astype(int), "chars": chars[ok], "h": list(h[ok])})

    seen = chosen.filter("own = 1").select("label", "text").mapInPandas(calibrate, "own int, chars double, h array<double>").toPandas()  # `rows` a language at most
    h, own = np.array(seen["h"].tolist(), float).reshape(-1, len(langs)), seen["own"].to_numpy(int)
    long_enough = seen["chars"].to_numpy(float) >= SURE
    usual = np.zeros((len(langs), 2))
    for j in range(len(langs)):
        mine = h[(own == j) & long_enough, j]
        usual[j] = (mine.mean(), max(0.02, mine.std())) if len(mine) else (np.log(1 << 16), 1.0)  # nothing known: reject nothing
    return langs, models, usual, temperature(h, own, usual)


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", rows: int = TRAIN_ROWS) -> DataFrame:
    """Every row's id, held_out, lang_pred, score, rejected."""
    shared = df.sparkSession.sparkContext.broadcast(train(df, id_col, text_col, label_col, rows))

    def judge(block: list[tuple]) -> pa.RecordBatch:
        langs, models, usual, heat = shared.value
        h, chars = entropies([b[2] for b in block], models)
        none = (chars == 0) | (not langs)
        if langs:
            best, score = scores(h, usual, heat)
            rejected = h[np.arange(len(h)), best] > usual[best, 0] + REJECT * usual[best, 1]
            names = np.array(langs, object)[best]
        else:
            score, rejected, names = np.zeros(len(block)), np.ones(len(block), bool), np.full(len(block), "und", object)
        names = np.where(none, "und", names)
        return pa.RecordBatch.from_arrays(
            [pa.array([b[0] for b in block], pa.int64()), pa.array([b[1] for b in block], pa.bool_()), pa.array(names.tolist(), pa.string()),
             pa.array(np.where(none, 0.0, score)), pa.array(rejected | none)],
            [id_col, "held_out", "lang_pred", "score", "rejected"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        block, size = [], 0
        for some in (x for batch in batches for x in slices(batch)):
            for row in zip(*(c.to_pylist() for c in some.columns), strict=True):
                block.append(row)
                size += len(row[2] or "")
                if size > BLOCK:
                    yield judge(block)
                    block, size = [], 0
        if block:
            yield judge(block)

    typed = df.select(F.col(id_col).cast("long"), F.coalesce(fold(id_col) == 1, F.lit(False)).alias("held_out"), F.col(text_col).cast("string"))
    return typed.mapInArrow(run, f"`{id_col}` long, held_out boolean, lang_pred string, score double, rejected boolean")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
