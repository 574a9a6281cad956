"""URL filters: a sort-merge range join of urls with nested host and path rules.

A host's labels, reversed and each closed by U+0001, are its canonical key: a
rule's host and all its subdomains are then one interval of keys. Places in the
order of (key, id) are cut into ranges at the keys of a sample of urls, which only
decides where the cuts lie. A url goes to its range, a rule to every range that its
interval meets; in each range urls and rules are sorted together, and a sweep keeps
the stack of the rules whose interval is open. A hot host is many ranges. Rules
are never on the driver.

A null url, or one without "://", has an empty host and path; no rule fits it.
Ties between rules of equal length go to the longer host. Of rules with the same
host and path a block wins. Rules with a null part are ignored. Repeated urls are
judged row by row; a null id sorts first. Empty urls or rules give rows without a
rule, or no rows. Other input columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gapweave.llm.common import table, tasks_for

#: Urls sampled for each range.
SAMPLE = 20
END = "\x01"
#: Behind every key that starts with another one.
LAST = "\U0010ffff"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the query: verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, in lower case, and path of a url; both empty if there is no "://"."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(`{0}`, instr(`{0}`, '://') + 3)".format("_url"))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """The labels of a host in reverse, each closed by END."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), END), F.lit(END))


class Open:
    """The open rules of one host: their paths by length."""

    def __init__(self, key: str):
        self.key, self.paths, self.sizes = key, {}, []

    def add(self, path: str, rule: list) -> None:
        old = self.paths.get(path)
        if old is None or rule[2] == "block":
            self.paths[path] = rule
        self.sizes = sorted({len(p) for p in self.paths}, reverse=True)

    def best(self, path: str) -> list | None:
        return next((self.paths[path[:n]] for n in self.sizes if path[:n] in self.paths), None)


def longest(stack: list[Open], key: str, path: str) -> list | None:
    """The longest rule on the stack that fits."""
    fit = [r for o in stack if key.startswith(o.key) and (r := o.best(path))]
    return max(fit, key=lambda r: (len(r[0]) + len(r[1]), len(r[0])), default=None)


SWEPT = "id long, host string, path string, rule string, verdict string"


def sweep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Over a task's sorted rules and urls, range by range: each url's longest rule of those open."""
    stack: list[Open] = []
    at = None
    for x in frames:
        out = []
        for part, doc, host, path, key, verdict in zip(x["part"], x["id"], x["host"], x["path"], x["key"], x["verdict"], strict=True):
            if part != at:
                at, stack = part, []
            while stack and not key.startswith(stack[-1].key):
                stack.pop()
            if verdict:
                if not stack or stack[-1].key != key:
                    stack.append(Open(key))
                stack[-1].add(path, [host, path, verdict])
            else:
                got = longest(stack, key, path)
                out.append((doc, host, path, got and got[0] + got[1], got and got[2]))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SWEPT.split(", ")]).astype({"id": "Int64"})


def swept(urls: DataFrame, rules: DataFrame, tasks: int) -> DataFrame:
    smallest = -(1 << 63)
    place = F.struct("key", F.coalesce("id", F.lit(smallest)).alias("id"))
    some = urls.select(place.alias("at")).orderBy(F.xxhash64("at")).limit(tasks * SAMPLE).collect()
    keys = sorted((r["at"]["key"], r["at"]["id"]) for r in some)
    cuts = sorted({keys[len(keys) * k // tasks] for k in range(1, tasks)}) if keys else []

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Urls to their range, rules to all ranges from the first to the last that their interval meets."""
        for x in frames:
            lows, highs = [], []
            for key, doc, verdict in zip(x["key"], x["id"], x["verdict"], strict=True):
                doc = smallest if pd.isna(doc) else int(doc)
                lows.append(bisect_right(cuts, (key, smallest - 1 if verdict else doc)))
                highs.append(bisect_right(cuts, (key + LAST, 0)) if verdict else lows[-1])
            yield x.assign(low=lows, high=highs)

    typed = "id long, host string, path string, key string, verdict string"
    events = urls.withColumn("verdict", F.lit(None).cast("string")).unionByName(rules.withColumn("id", F.lit(None).cast("long"))).select("id", "host", "path", "key", "verdict")
    sent = events.mapInPandas(send, typed + ", low int, high int").withColumn("part", F.explode(F.sequence("low", "high")))
    ordered = sent.repartition(tasks, "part").sortWithinPartitions("part", "key", F.col("verdict").isNull(), "id")
    return ordered.select("part", "id", "host", "path", "key", "verdict").mapInPandas(sweep, SWEPT)


def filter_urls(df: DataFrame, rules: DataFrame, id_col: str, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Every row's id, host, path, rule and verdict under `rules` (verdict, host, path)."""
    named = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("_url"))
    host, path = url_parts(F.col("_url"))
    urls = named.select("id", host.alias("host"), path.alias("path")).withColumn("key", host_key(F.col("host")))
    lists = rules.select("verdict", "host", "path").dropna().withColumn("host", F.translate("host", UPPER, LOWER)).withColumn("key", host_key(F.col("host")))
    out = swept(urls, lists, tasks_for(df))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return filter_urls(table(spark, sf_dir, "pages"), rules, "page_id")


SQL = {
    "op6_url_filters": """
WITH rules(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT p.*, rhost || rpath AS rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST) AS k
      FROM p LEFT JOIN rules r ON (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
}
