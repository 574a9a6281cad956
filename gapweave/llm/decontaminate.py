"""Benchmark decontamination by spaced seeds, JVM-side only.

Texts are lower-cased runs of letters and digits, hashed word by word. A mask keeps
some positions of a window and ignores the others; windows of documents and of
benchmark items meet by the hash of the kept words. Around a hit the words of item
and document are compared along its diagonal: a document is contaminated if in a
window of WINDOW words of the item (or the whole of a shorter one) all but a few
agree. With positions 0, 3, 6, 9 kept, any 13 words with two substitutions have an
intact residue class modulo 3, and with 0, 2, 4, 6 any eight words with one have
one modulo 2, so no such overlap is missed.

Null and empty texts, and items of fewer than four words, match nothing. Items are
taken in blocks of WORDS words, however many there are; a block's seeds, without
words, and its items are broadcast, so a passage that a third of all rows share
meets them without a shuffle. A text's distinct seeds meet an item's, and positions
are paired within the row, so a word that fills a text costs no row for each pair
of places. Rows that share their id columns, and items that share an id, are
reported as one; a null id is a value like others. Other columns are ignored. An
empty table on either side gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gapweave.llm.common import bound, few, stage, table, total

#: Kept positions, for items of at least so many words and fewer than so many.
MASKS = (((0, 3, 6, 9), 12, None), ((0, 2, 4, 6), 8, 12), ((0, 1, 3), 4, 8))
WINDOW = 13
#: Words of benchmark items broadcast at once.
WORDS = 1_000_000


def word_hashes(df: DataFrame, text: Column, to: str) -> DataFrame:
    """Adds `to`, the hashes of a text's words."""
    df = df.withColumn(to, F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"))
    ends = F.when(F.element_at(to, -1) == "", 1).otherwise(0)
    starts = F.when(F.element_at(to, 1) == "", 1).otherwise(0)
    df = df.withColumn(to, F.slice(to, 1 + starts, F.greatest(F.size(to) - starts - ends, F.lit(0))))
    return df.withColumn(to, F.transform(to, lambda w: F.xxhash64(w)))


def seeds(hashes: Column, mask: tuple[int, ...]) -> Column:
    """The hash of the kept words at every position of the mask."""
    n = F.greatest(F.size(hashes) - mask[-1], F.lit(0))
    out = F.slice(hashes, F.lit(1), n)
    for at in mask[1:]:
        out = F.zip_with(out, F.slice(hashes, F.lit(1 + at), n), lambda x, y: F.xxhash64(x, y))
    return out


def tolerance(words: Column) -> Column:
    """Substitutions allowed in the compared window of an item of so many words."""
    return F.when(words >= 12, 2).when(words >= 8, 1).otherwise(0)


def windows(own: Column, item: Column, at_own: Column, at_item: Column) -> Column:
    """All windows of a hit, as (first_word of the document, matched_words), that agree well enough.

    A window starts up to WINDOW - 1 words before a seed that it holds. Places are cells, a diagonal and a block of item
    words, so that many pairs of places on one diagonal are looked at once.
    """
    width = F.least(F.lit(WINDOW), F.size(item))
    pairs = F.flatten(F.transform(at_own, lambda p: F.transform(at_item, lambda a: F.struct((p - a).alias("diagonal"), F.floor(a / WINDOW).cast("int").alias("block")))))

    def around(c: Column) -> Column:
        first = F.greatest(F.lit(0), -c.diagonal, WINDOW * (c.block - 1) + 1)
        last = F.least(F.size(item) - width, F.size(own) - width - c.diagonal, WINDOW * (c.block + 1) - 1)
        n = F.greatest(last - first + width, F.lit(0))
        eq = F.zip_with(F.slice(own, c.diagonal + first + 1, n), F.slice(item, first + 1, n), lambda x, y: (x == y).cast("int"))
        starts = F.when(last >= first, F.sequence(F.lit(0), last - first)).otherwise(F.array().cast("array<int>"))
        return bound(eq, lambda e: F.transform(starts, lambda k: F.struct((c.diagonal + first + k).alias("first_word"), total(F.slice(e, k + 1, width)).alias("matched_words"))))

    all_ = F.flatten(F.transform(F.array_distinct(pairs), around))
    return F.filter(all_, lambda w: w.matched_words >= width - tolerance(F.size(item)))


def overlaps(docs: DataFrame, items: DataFrame, id_cols: list[str], text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Verified overlaps: id columns, item_id, first_word (of the document, of the first window that agrees), matched_words
    (the most in one window), item_words; one row per document and item."""
    bench = word_hashes(items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").alias("_b")), F.col("_b"), "item").drop("_b")
    # distinct: items of equal words and id are one
    bench = stage(bench.filter(F.size("item") >= 4).distinct().withColumn("no", F.monotonically_increasing_id()), "items")
    blocks = -(-(bench.agg(F.sum(F.size("item"))).collect()[0][0] or 0) // WORDS)
    own = word_hashes(docs.select(*[F.col(f"`{c}`") for c in id_cols], F.col(f"`{text_col}`").alias("_t")), F.col("_t"), "own").drop("_t")
    found = None
    for i in range(blocks):
        block = bench.filter(F.pmod(F.xxhash64("no"), F.lit(blocks)) == i)
        for mask, least, below in MASKS:
            some = block.filter((F.size("item") >= least) & (F.size("item") < below if below else F.lit(True)))
            each = some.select("no", F.posexplode(seeds(F.col("item"), mask)).alias("at", "seed"))
            table_ = stage(each.groupBy("seed", "no").agg(F.collect_list("at").alias("at_item")), "seeds")  # the benchmark only
            if table_.isEmpty():
                continue
            # outer: else the optimizer filters by the size of the whole nested expression; a null seed meets nothing
            placed = own.withColumn("seeds", seeds(F.col("own"), mask))
            placed = placed.select(*id_cols, "own", "seeds", F.explode_outer(F.array_distinct("seeds")).alias("seed"))
            hits = placed.join(F.broadcast(table_), "seed").join(F.broadcast(some), "no")
            at_own = F.filter(F.transform("seeds", lambda s, j: F.when(s == F.col("seed"), j)), lambda j: j.isNotNull())
            # the row number keeps what follows from being computed twice, as a filter and as a column
            hits = hits.select(*id_cols, "item_id", F.size("item").alias("item_words"), bound(at_own, lambda p: windows(F.col("own"), F.col("item"), p, F.col("at_item"))).alias("windows"), F.monotonically_increasing_id().alias("_n"))
            kept = hits.filter((F.col("_n") >= 0) & (F.size("windows") > 0)).select(
                *id_cols, "item_id", "item_words", F.array_min(F.transform("windows", lambda w: w.first_word)).alias("first_word"), F.array_max(F.transform("windows", lambda w: w.matched_words)).alias("matched_words")
            )
            found = kept if found is None else found.unionByName(kept)
    if found is None:
        return docs.select(*id_cols).limit(0).select(*id_cols, F.lit(None).cast(items.schema[item_id].dataType).alias("item_id"), F.lit(0).alias("first_word"), F.lit(0).cast("long").alias("matched_words"), F.lit(0).alias("item_words"))
    return found.groupBy(*id_cols, "item_id").agg(F.min("first_word").alias("first_word"), F.max("matched_words").alias("matched_words"), F.max("item_words").alias("item_words"))


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("_k1"), F.xxhash64(F.lit(1), t).alias("_k2")]


def clean_rows(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose text overlaps no item, with their own columns."""
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text_col}`").alias("_text"), *text_key(F.col(f"`{text_col}`")))
    bad = stage(overlaps(keyed, items, ["_k1", "_k2"], "_text").select("_k1", "_k2").distinct(), "contaminated")
    return keyed.join(few(bad), ["_k1", "_k2"], "left_anti").select("_row.*")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])


def twin() -> str:
    """The same in SQL: every place where a mask's words agree, then all windows that hold them."""
    parts = []
    for mask, least, below in MASKS:
        seed = "[" + ", ".join(f"w[p + {m}]" for m in mask) + "]"
        some = f"len(w) >= {least}" + (f" AND len(w) < {below}" if below else "")
        parts.append(f"""SELECT doc_id, item_id, dw, bw, dp, bp FROM (SELECT doc_id, w AS dw, p AS dp, {seed} AS seed FROM (SELECT doc_id, w, unnest(range(1, len(w) - {mask[-1]} + 1)) AS p FROM d)) x
JOIN (SELECT item_id, w AS bw, p AS bp, {seed} AS seed FROM (SELECT item_id, w, unnest(range(1, len(w) - {mask[-1]} + 1)) AS p FROM b WHERE {some})) y USING (seed)""")
    words = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w"
    return f"""WITH d AS (SELECT doc_id, {words} FROM documents), b AS (SELECT item_id, {words} FROM benchmark),
h AS ({' UNION ALL '.join(parts)}),
s AS (SELECT *, least({WINDOW}, len(bw)) AS n, unnest(range(0, {WINDOW})) AS back FROM h),
v AS (SELECT doc_id, item_id, len(bw) AS item_words, n, dp - back - 1 AS first_word, list_sum(list_transform(range(0, n), lambda j: (dw[dp - back + j] = bw[bp - back + j])::INT)) AS eq
      FROM s WHERE bp > back AND dp > back AND bp - back + n - 1 <= len(bw) AND dp - back + n - 1 <= len(dw))
SELECT doc_id, item_id, min(first_word)::INT AS first_word, max(eq)::BIGINT AS matched_words, max(item_words)::INT AS item_words
FROM v WHERE eq >= n - CASE WHEN item_words >= 12 THEN 2 WHEN item_words >= 8 THEN 1 ELSE 0 END GROUP BY doc_id, item_id"""


SQL = {"op5_benchmark_decontamination": twin()}
