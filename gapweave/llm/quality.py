"""Quality rules: one threshold table compiled into one projection, JVM-side only.

Null text counts as empty. Texts of any length are judged whole; work is linear
in the words (n log n where windows repeat). Every row is judged on its own, so
ties, repeated rows and skew have no effect. Columns of the input other than
`id_col` and `text_col` are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gapweave.llm.common import paired, table, total, words

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in a is that it for on was with as be this by are an at from or "
    "le la les de des et un une est que qui pour dans en du par au "
    "der die das und ist von zu mit den auf ein eine "
    "el los las y es por con del se para"
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails the rule if metric `what` is below `low` or above `high`.

    The rule applies from `least` words on.
    """

    name: str
    what: str
    low: float | None = None
    high: float | None = None
    least: int = 0


#: The threshold table. Ratios are per word, or per line that has a word.
RULES = (
    Rule("short_words", "mean_word_chars", low=2.0),
    Rule("long_words", "mean_word_chars", high=15.0),
    Rule("symbols", "symbol_ratio", high=0.2),
    Rule("repeated_lines", "dup_line_ratio", high=0.3),
    Rule("stop_words", "stop_ratio", low=0.02, least=20),
)


def chars_in(text: Column, chars: str) -> Column:
    """How many characters of `text` are among `chars`."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def window_hashes(df: DataFrame, words_col: str, to: str) -> DataFrame:
    """Adds `to`, the hashes of all 8-word windows, which double in width: 1, 2, 4, 8 words.

    Each width is a projection of its own, or it would be evaluated for each use.
    """
    df = df.withColumn(to, F.transform(words_col, lambda w: F.xxhash64(w)))
    for step in (1, 2, 4):
        df = df.withColumn(to, paired(F.col(to), step, F.size(to), lambda a, b: F.xxhash64(a, b)))
    return df


def covered(windows: Column) -> Column:
    """Words under the repeated ones among the 8-word windows with these hashes."""
    at = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twins = F.transform(
        F.array(at),
        lambda x: F.flatten(paired(x, 1, F.size(x), lambda a, b: F.when(a.h == b.h, F.array(a.i, b.i)).otherwise(F.array().cast("array<int>")))),
    )
    starts = F.transform(twins, lambda x: F.array_sort(F.array_distinct(x)))
    return F.element_at(F.transform(starts, lambda x: total(paired(x, 1, F.size(x), lambda a, b: F.least(F.lit(8), b - a))) + F.lit(8)), 1)


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """Metrics and verdict of every row: id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, failed (the names of the rules that failed).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = df.select(F.col(id_col), text.alias("_t"), words(F.col(text_col)).alias("_w"))
    out = window_hashes(out, "_w", "_h")
    lines = F.filter(F.split(F.col("_t"), "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")
    stop = [F.lit(w) for w in STOP_WORDS]
    out = out.select(
        id_col,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate(F.col("_t"), " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        chars_in(F.col("_t"), "#*$%&|<>").cast("long").alias("n_symbols"),
        lines.alias("_l"),
        "_h",
        F.size(F.filter("_w", lambda w: F.lower(w).isin(stop))).alias("_stop"),
    )
    out = out.select(
        id_col, "n_words", "word_chars", "n_symbols", "_stop",
        F.size("_l").alias("_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_h")) == F.size("_h"), F.lit(0).cast("long")).otherwise(covered(F.col("_h"))).alias("n_repeat_words"),
    )
    per_word = lambda c: F.try_divide(F.col(c), F.col("n_words"))
    metrics = {
        "mean_word_chars": per_word("word_chars"),
        "symbol_ratio": per_word("n_symbols"),
        "dup_line_ratio": F.try_divide(F.col("n_dup_lines"), F.col("_lines")),
        "stop_ratio": per_word("_stop"),
    }

    def fails(r: Rule) -> Column:
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (metrics[r.what] < r.low)
        if r.high is not None:
            bad = bad | (metrics[r.what] > r.high)
        return F.coalesce(bad & (F.col("n_words") >= r.least), F.lit(False))

    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    failed = F.filter(F.array(*[F.when(fails(r), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    return out.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), failed.alias("failed"),
    ).select("*", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"))


def kept_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df` that pass, with their own columns; the metrics ride along, so nothing is joined."""
    own = df.columns
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"))
    judged = quality(packed.select("_row", F.col(f"_row.`{text_col}`").alias("_text")), "_row", "_text")
    # the row number keeps the filter above the metrics; pushed below, it would repeat them for each of its terms
    numbered = judged.select("_row", "kept", F.monotonically_increasing_id().alias("_n"))
    return numbered.filter(F.col("kept") & (F.col("_n") >= 0)).select("_row.*")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).drop("failed")


SQL = {
    "op7_quality_rules": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words,
             length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines,
             len(list_filter(w, lambda x: list_contains(string_split('STOPS', ' '), lower(x)))) AS n_stop FROM w),
g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
r AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n_repeat_words
      FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM d) GROUP BY doc_id),
x AS (SELECT m.*, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM m LEFT JOIN r USING (doc_id)),
y AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM x)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words >= 2.0 AND word_chars / n_words <= 15.0 AND n_symbols / n_words <= 0.2
       AND NOT (n_dup_lines / n_lines > 0.3) AND NOT (n_words >= 20 AND n_stop / n_words < 0.02) AS kept
FROM y
""".replace("STOPS", " ".join(STOP_WORDS))
}
