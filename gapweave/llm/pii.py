"""Personal data: base spans, and terms that give protected entities away, JVM-side only.

Base spans are e-mail addresses, ip addresses, card and phone numbers by fixed
patterns, leftmost first within a kind, failing matches dropped. Their values are
the protected entities. Over the distinct texts of the corpus, n(t, e) counts at
how many mentions of entity e term t (a blank-separated word, lower-cased, outer
signs cut off) stands within NEAR words and WIDE code points, up to the next match
of the entity's kind, and n(t) how often it stands anywhere;
P(e | t) = n(t, e) / n(t) is what a reader of t knows of e. All terms near an
entity are counted, also those of a single text. A term that carries BITS of
information on e, exceeds the disclosure threshold and stands near e more often
than chance explains is a span too, wherever it stands: from GENERALISE on it is
replaced by a class mark, from REMOVE on it is taken out. Chance: a word stands
near e with the share q of all words that do; n(t) draws have a tail of at most
2 ** -(n(t) * KL(P, q)), which times the number of pairs (t, e) may be RISK.

Null text counts as empty. All matches of whole texts are found, at any length;
patterns do not backtrack, and places come from running sums, so a text with many
spans or terms costs little more than its length. Equal texts count once, so copies
alone disclose nothing. Repeated ids are judged row by row; a null id is kept.
Words are summed before the shuffle, so a hot term is one row a task. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gapweave.llm.common import FEW, SPACE_CLASS, SPACES, before, bound, few, stage, table, total
from gapweave.llm.decontaminate import text_key

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. A run is entered only at its start or after the last match, and never given back: one pass over any text.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a pattern to be tried.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
NEAR, WIDE = 5, 200
#: Code points of a text that are cut out of it together when it is put together anew.
CUT = 1000
BITS = 4.0
GENERALISE, REMOVE = 0.5, 0.9
#: How likely chance may make any term of the corpus a disclosing one.
RISK = 0.05
SIGNS = ".,;:!?()[]{}\"'"
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"
FOUND = "array<struct<kind:string,start:int,end:int,value:string,left:string,right:string>>"


def valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return ~F.exists(F.split(m, r"\."), lambda p: ~p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "phone":
        return F.length(digits).between(9, 15)

    def doubled(d: Column, i: Column) -> Column:
        v = F.ascii(d) - 48
        return F.when(i % 2 == 0, v).otherwise(F.when(v > 4, 2 * v - 9).otherwise(2 * v))

    long_enough = F.length(digits).between(13, 19)
    each = F.filter(F.split(F.reverse(digits), ""), lambda d: d != "")
    return F.when(long_enough, total(F.transform(each, doubled)) % 10 == 0).otherwise(F.lit(False))


def found(kind: str, text: str) -> Column:
    """The valid spans of a kind, in order, with the text before and after them up to the next match."""
    t, pattern = F.col(text), F.lit(PATTERNS[kind])
    packed = F.struct(F.regexp_extract_all(t, pattern, F.lit(0)).alias("m"), F.split(t, PATTERNS[kind], -1).alias("g"))

    def place(p: Column) -> Column:
        begins = before(F.zip_with(F.slice(p.g, F.lit(1), F.size(p.m)), p.m, lambda x, y: (F.length(x) + F.length(y)).cast("long")))
        good = F.filter(F.transform(p.m, lambda x, i: F.struct(x.alias("value"), i.alias("i"))), lambda s: valid(kind, s.value))

        def spans(b: Column) -> Column:
            start = lambda s: (b[s.i] + F.length(p.g[s.i])).cast("int")
            return F.transform(
                good,
                lambda s: F.struct(
                    F.lit(kind).alias("kind"), start(s).alias("start"), (start(s) + F.length(s.value)).alias("end"), s.value.alias("value"),
                    p.g[s.i].alias("left"), p.g[s.i + 1].alias("right"),
                ),
            )

        return bound(begins, spans)

    tried = t.rlike("[0-9]") if kind == "card" else F.contains(t, F.lit(NEEDS[kind]))
    here = F.when(tried & t.rlike(PATTERNS[kind]), bound(packed, place))
    return F.coalesce(here, F.array().cast(FOUND))


def entity(s: Column) -> Column:
    """What a span names, however it is written."""
    digits = F.regexp_replace(s.value, "[^0-9]", "")
    return F.concat_ws(":", s.kind, F.when(s.kind.isin("card", "phone"), digits).otherwise(F.lower(s.value)))


def near(s: Column) -> Column:
    """The terms within NEAR words of a span, of more than one character; a word that the limit of WIDE cuts is none."""
    cut = lambda x, w, at: F.when(F.length(x) > WIDE, F.slice(w, F.lit(at), F.size(w) - 1)).otherwise(w)
    words = lambda x, side, at: F.filter(cut(x, F.split(side(x, F.lit(WIDE)), SPACE_CLASS), at), lambda w: w != "")
    last = bound(words(s.left, F.right, 2), lambda w: F.slice(w, F.greatest(F.size(w) - (NEAR - 1), F.lit(1)), F.lit(NEAR)))
    first = F.slice(words(s.right, F.left, 1), 1, NEAR)
    return F.filter(F.array_distinct(F.transform(F.concat(last, first), term)), lambda w: F.length(w) > 1)


def base_spans(df: DataFrame, carry: list[str], text: Column) -> DataFrame:
    """The columns `carry`, the text key, _n (words), spans (base, by kind, then start), and around: each span's entity and near terms."""
    out = df.select(*carry, F.coalesce(text.cast("string"), F.lit("")).alias("_t"))
    out = out.select("*", F.concat(*[found(k, "_t") for k in KINDS]).alias("_found"))
    spans = F.transform("_found", lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end"), s.value.alias("value")))
    around = F.transform("_found", lambda s: F.struct(entity(s).alias("entity"), near(s).alias("terms")))
    none = F.array().cast("array<struct<entity:string,terms:array<string>>>")
    # the pieces of a split at each single blank
    n = F.length("_t") - F.length(F.translate("_t", SPACES, "")) + 1
    return out.select(*carry, *text_key(F.col("_t")), n.alias("_n"), spans.alias("spans"), F.when(F.size("_found") > 0, around).otherwise(none).alias("around"))


def tokens(df: DataFrame) -> DataFrame:
    """Adds _w, the text split at each single blank, so positions can be told from lengths."""
    return df.withColumn("_w", F.split("_t", SPACE_CLASS, -1))


def term(word: Column) -> Column:
    return F.lower(F.btrim(word, F.lit(SIGNS)))


def disclosing_terms(words: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows (term, p, action) of the terms that exceed the disclosure thresholds. words: all texts split as _w, with their keys."""
    texts = spans.groupBy("_k1", "_k2").agg(F.count("*").alias("_c"), F.first("_n").alias("_n"), F.first(F.when(F.size("around") > 0, F.col("around")), True).alias("around"))
    texts = stage(texts, "texts")
    each = stage(texts.filter("around IS NOT NULL").select(F.explode("around").alias("a")).select("a.entity", "a.terms"), "mentions")
    own = each.select(term(F.regexp_extract("entity", "^[a-z]+:(.*)$", 1)).alias("term")).distinct()
    pairs = each.select("entity", F.explode("terms").alias("term")).join(own, "term", "left_anti")
    near_by = stage(pairs.groupBy("entity", "term").agg(F.count("*").alias("n_te")), "near_terms")
    copies = stage(texts.filter("_c > 1").select("_k1", "_k2", "_c"), "copies")
    once = words.join(few(copies), ["_k1", "_k2"], "left").select("_w", (1 / F.coalesce(F.col("_c"), F.lit(1))).alias("weight"))
    at = once.select(F.explode_outer("_w").alias("w"), "weight").select(term(F.col("w")).alias("term"), "weight")
    asked = stage(near_by.select("term").distinct(), "asked_terms")
    if asked.count() <= FEW:  # else words are summed before they meet the terms
        at = at.join(F.broadcast(asked), "term", "left_semi")
    # weights of copies add up to whole numbers
    counts = at.groupBy("term").agg(F.round(F.sum("weight")).alias("n_t"))
    entities = each.groupBy("entity").agg(F.count("*").alias("n_e"), F.sum(F.size("terms")).alias("near"))
    n_all = float(texts.agg(F.sum("_n").alias("n")).collect()[0].n or 1)
    tested = max(1, near_by.count())
    p = F.least(F.lit(1.0), F.col("n_te") / F.col("n_t"))
    bits = F.log2(F.col("p") * F.lit(n_all) / F.col("n_e"))
    q = F.least(F.lit(1.0), F.col("near") / F.lit(n_all))
    rest = F.when(F.col("p") < 1, (1 - F.col("p")) * F.log2((1 - F.col("p")) / (1 - q))).otherwise(F.lit(0.0))
    beyond = (F.col("p") > q) & (F.col("n_t") * (F.col("p") * F.log2(F.col("p") / q) + rest) >= F.log2(F.lit(tested / RISK)))
    joined = near_by.join(counts, "term").join(entities, "entity").withColumn("p", p)
    high = joined.filter((F.col("p") >= GENERALISE) & (bits >= BITS) & beyond).groupBy("term").agg(F.max("p").alias("p"))
    return high.withColumn("action", F.when(F.col("p") >= REMOVE, "remove").otherwise("generalise"))


def term_spans(df: DataFrame, terms: DataFrame, id_cols: list[str]) -> DataFrame:
    """For each row that has one, id columns and term_spans: where disclosing terms stand."""
    at = before(F.transform("_w", lambda w: (F.length(w) + 1).cast("long")))
    each = F.zip_with("_w", at, lambda w, x: F.struct(w.alias("w"), x.cast("int").alias("at")))
    hits = df.select(*id_cols, F.explode_outer(each).alias("e")).select(*id_cols, term(F.col("e.w")).alias("value"), "e.w", "e.at").join(few(terms.withColumnRenamed("term", "value")), "value")
    start = F.col("at") + F.length("w") - F.length(F.ltrim(F.col("w"), F.lit(SIGNS)))
    hits = hits.select(*id_cols, start.alias("start"), (start + F.length("value")).alias("end"), "value", "action").dropDuplicates([*id_cols, "start"])
    return hits.groupBy(*id_cols).agg(F.collect_list(F.struct(F.col("action").alias("kind"), "start", "end", "value")).alias("term_spans"))


def clear(base: Column, terms: Column) -> Column:
    """The term spans that touch no base span, by start."""
    far = (1 << 31) - 1
    is_base = lambda s: s.kind.isin(*KINDS)

    def kept(a: Column) -> Column:
        ends = before(F.transform(a, lambda s: F.when(is_base(s), s.end).otherwise(0).cast("long")), most)
        starts = F.reverse(before(F.reverse(F.transform(a, lambda s: F.when(is_base(s), s.start).otherwise(far).cast("long"))), least, F.lit(far).cast("long")))
        sides = F.struct(ends.alias("ends"), starts.alias("starts"))
        each = bound(sides, lambda e: F.transform(a, lambda s, i: F.struct(s.alias("s"), (~is_base(s) & (e.ends[i] <= s.start) & (e.starts[i] >= s.end)).alias("ok"))))
        return F.transform(F.filter(each, lambda x: x.ok), lambda x: x.s)

    return bound(in_order(F.concat(base, terms)), kept)


def in_order(spans: Column) -> Column:
    """By start, longer ones first."""
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s.start.alias("start"), (-s.end).alias("x"), s.alias("s"))))
    return F.transform(keyed, lambda k: k.s)


def all_spans(df: DataFrame, text: Column, carry: list[str]) -> DataFrame:
    """The columns `carry`, spans (base) and term_spans (those that touch no base span, by start)."""
    based = stage(base_spans(df, carry, text), "base_spans")
    # equal texts have equal spans, found twice and kept once
    keyed = tokens(df.select(F.coalesce(text.cast("string"), F.lit("")).alias("_t"))).select("_w", *text_key(F.col("_t")))
    terms = stage(disclosing_terms(keyed, based), "terms")
    if terms.isEmpty():
        return based.select(*carry, "spans", F.array().cast(SPANS).alias("term_spans"))
    found = stage(term_spans(keyed, terms, ["_k1", "_k2"]), "term_spans")
    joined = based.join(few(found), ["_k1", "_k2"], "left").select(*carry, "spans", "term_spans")
    own = F.when(F.col("term_spans").isNull(), F.array().cast(SPANS)).otherwise(clear(F.col("spans"), F.col("term_spans")))
    return joined.select(*carry, "spans", own.alias("term_spans"))


def replaced(text: Column, spans: Column, marks: Column) -> Column:
    """The text with each run of overlapping spans replaced by the mark of its first one."""
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))
    place = lambda x: F.floor(x / CUT).cast("int")

    def cut(c: Column, a: Column, b: Column) -> Column:
        some = F.array_join(F.slice(c, place(a) + 1, place(b - 1) - place(a) + 1), "")
        return F.when(b > a, F.substring(some, (a % CUT + 1).cast("int"), (b - a).cast("int"))).otherwise(F.lit(""))

    def put(p: Column) -> Column:
        each = F.transform(p.s, lambda x, i: F.struct(x.start.cast("long").alias("start"), x.kind.alias("kind"), p.reach[i].alias("upto")))
        parts = F.transform(F.filter(each, lambda x: x.start >= x.upto), lambda x: F.concat(cut(p.c, x.upto, x.start), marks[x.kind]))
        end = F.array_max(F.transform(p.s, lambda x: x.end.cast("long")))
        return F.concat(F.array_join(parts, ""), cut(p.c, end, p.n))

    def laid(s: Column) -> Column:
        reach = before(F.transform(s, lambda x: x.end.cast("long")), most)
        return bound(F.struct(s.alias("s"), reach.alias("reach"), chunks.alias("c"), F.length(text).cast("long").alias("n")), put)

    return bound(in_order(spans), laid)


def most(x: Column, y: Column) -> Column:
    return F.greatest(x, y)


def least(x: Column, y: Column) -> Column:
    return F.least(x, y)


def spelt(spans: Column, kind: Column | None = None) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind if kind is not None else s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id, counts by kind, base_sha256, spans, n_terms."""
    got = all_spans(df, F.col(text_col), [id_col])
    count = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    base = spelt(F.col("spans"))
    return got.select(
        id_col, *[count(k) for k in KINDS], F.sha2(base, 256).alias("base_sha256"),
        F.concat_ws(",", F.when(base != "", base), F.when(F.size("term_spans") > 0, spelt(F.col("term_spans"), F.lit("term")))).alias("spans"),
        F.size("term_spans").cast("long").alias("n_terms"),
    )


def redact(df: DataFrame, text_col: str = "text", measure: str | None = None) -> DataFrame:
    """The rows of `df` with spans in `text_col` replaced: entities by class marks, terms generalised or taken out.

    `measure` names a column, if there is one, that holds the length of the text.
    """
    own = df.columns
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"))
    text = F.col(f"_row.`{text_col}`")
    got = all_spans(packed, text, ["_row"]).withColumn("_all", F.concat("spans", "term_spans"))
    marks = F.create_map(*[F.lit(x) for kv in (MARKS | {"generalise": "[TERM]", "remove": ""}).items() for x in kv])
    new = F.when(F.size("_all") > 0, replaced(text.cast("string"), F.col("_all"), marks)).otherwise(text)
    changed = got.select("_row", (F.size("_all") > 0).alias("_more"), new.alias("_new"))

    def column(c: str) -> Column:
        old = F.col(f"_row.`{c}`")
        if c == text_col:
            return F.col("_new").alias(c)
        if c == measure:
            return F.when(F.col("_more"), F.length("_new").cast(df.schema[c].dataType)).otherwise(old).alias(c)
        return old.alias(c)

    return changed.select(*[column(c) for c in own])


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
