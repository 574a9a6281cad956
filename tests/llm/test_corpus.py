"""The corpus operators on edge cases and against plain restatements."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapweave.llm import counts, decontaminate, html, langid, ngram_join, packing, pii, quality, shards, tokens, urls
from gapweave.llm.common import stage

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
BASE = "the quick brown fox jumps over the lazy dog and runs to the far hill where it sleeps for a while in the sun"
BENCH = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau"
LONG = " ".join(f"w{i % 977} x{i}" for i in range(30_000))
TEXTS = [
    BASE, BASE, BASE + " again", BASE.upper(), None, "", " \n\t ", "one two", "one two", "!!! ### $$$", "line a\nline a\nline b\n", LONG, LONG + " end",
    "write to a.b@c.de or b@c.d_e@f.gh, call +1 (988) 555-2485; 42.144.35.254 256.1.1.1, 4111 1111 1111 1111", "é😀 x@y.zz 😀 1.1.1.1",
    "9" * 3000, "so " * 50, "prefix words here " + BENCH + " and a suffix", "prefix " + BENCH.replace("theta", "other").replace("nu", "new") + " end", "alpha beta gamma delta",
]
CLASH = ["spans", "own", "_t", "_w", "_row", "_keep", "_k1", "seeds", "part", "rank", "sid", "n", "label", "key", "lang2"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if i == 2 else i // 2 if i == 1 else i, t, None if i % 3 == 0 else "en", "s", None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return stage(df.withColumns({c: F.lit("x") for c in CLASH}), "docs")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, BENCH), (2, None), (3, ""), (4, "a b"), (5, "one two three four five")], "item_id long, text string")


def by_text(docs, rows):
    """Results by document id next to the documents, in any order."""
    return collections.Counter(rows), {r.doc_id: r.text for r in docs.collect()}


def test_quality(docs, none):
    assert quality.quality(none).count() == 0
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality(docs).collect()}
    want = set()
    for r in docs.collect():
        t = r.text or ""
        w = WORD.findall(t)
        at = collections.defaultdict(list)
        for i in range(len(w) - 7):
            at[tuple(w[i : i + 8])].append(i)
        under = {j for p in at.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want.add((r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(under), len(w) < 20 or 100 * len(under) > 30 * len(w)))
    assert got == want
    kept = quality.kept_rows(docs)
    assert kept.columns == docs.columns and BASE in {r.text for r in kept.collect()} and "so " * 50 not in {r.text for r in kept.collect()}


KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def holds(kind, m):
    d = re.sub("[^0-9]", "", m)
    luhn = lambda: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.split(".")), "phone": lambda: 9 <= len(d) <= 15, "card": lambda: 13 <= len(d) <= 19 and luhn()}[kind]()


def spans_of(t):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in KINDS.items() for m in re.finditer(p, t or "") if holds(k, m.group()))


def test_pii(spark, docs, none):
    assert pii.find(none).count() == 0 and pii.redact(none).count() == 0
    got = collections.Counter((r.doc_id, r.base_sha256) for r in pii.find(docs).collect())
    assert got == collections.Counter((r.doc_id, hashlib.sha256(spans_of(r.text).encode()).hexdigest()) for r in docs.collect())
    new = pii.redact(docs, measure="n_chars")
    assert new.columns == docs.columns
    rows = {r.doc_id: r for r in new.collect()}
    assert "[EMAIL]" in rows[13].text and "[CARD]" in rows[13].text and "a.b@c.de" not in rows[13].text and rows[13].n_chars == len(rows[13].text)
    assert rows[0].text == BASE and rows[4].text is None


def test_pii_terms(spark):
    """A word that stands only near one address in several texts gives it away; copies of one text do not."""
    told = [f"{x} mail zorblax me@here.org about {x} things" for x in ("red", "blue", "green", "black")]
    texts = told + ["copy quux only@once.org"] * 5 + [f"mail about {i} things and zeta" for i in range(40)] + ["zorblax alone"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(df).collect()}
    t = texts[-1]
    assert got[len(texts) - 1].spans == f"term:{t.index('zorblax')}:{t.index('zorblax') + 7}"
    assert got[0].n_terms == 1 and got[4].n_terms == 0
    assert {r.doc_id: r.text for r in pii.redact(df).collect()}[0].startswith("red mail ")
    assert "zorblax" not in "".join(r.text for r in pii.redact(df).collect())


def test_pii_terms_of_one_text(spark):
    """A rare word beside an address of one text only gives it away in a corpus large enough to tell; copies change nothing."""
    rng = np.random.default_rng(5)
    filler = [" ".join(f"v{k}" for k in rng.integers(0, 50, 100)) for _ in range(200)]
    texts = ["v1 v2 ask grobnik mail one@once.org v3 v4"] * 3 + ["ask v5"] * 4 + [f"ask v6 x{i}" for i in range(40)] + filler
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(df).collect()}
    assert all(got[i].n_terms == 2 and "term:10:17,term:18:22" in got[i].spans for i in range(3))
    assert sum(r.n_terms for r in got.values()) == 6
    assert {r.doc_id: r.text for r in pii.redact(df).collect()}[0] == "v1 v2 ask   [EMAIL] v3 v4"


def test_pii_many_spans(spark):
    """A text of many spans, with and without room between them, costs seconds; what overlaps is replaced once."""
    import time

    rng = np.random.default_rng(7)
    part = lambda i: ["x%d@y.org" % i, "+49 (30) 1234 %05d" % i, "10.0.%d.%d" % (i % 256, i // 256 % 256), "é😀 word", "4111 1111 1111 1111"][int(rng.integers(5))]
    text = "".join(part(i) + str(rng.choice([" ", "\n", ", ", " and more words "])) for i in range(100_000))
    df = spark.createDataFrame([(1, text), (2, "x@y.zz"), (3, None)], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in pii.find(df).collect()}
    new = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert time.time() - began < 120
    assert got[1].base_sha256 == hashlib.sha256(spans_of(text).encode()).hexdigest()
    spans = sorted((int(a), -int(b), k) for k, a, b in (x.split(":") for x in got[1].spans.split(",")))
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}.get(kind, "?")]
        at = max(at, -b)
    want = "".join(out) + text[at:]
    assert got[1].n_terms or new[1] == want
    assert new[2] == "[EMAIL]" and new[3] is None


def test_packing(docs, none):
    assert packing.pack(none).count() == 0
    rows = packing.pack(docs).collect()
    tok = tokens.WordIds(tokens.vocabulary()).tok
    want = collections.Counter()
    for r in docs.collect():
        ids = np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        for k in range(0, len(ids), 2048):
            want[(r.doc_id, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, n in sorted(places):
            assert offset == end
            end += n
        assert end <= 2048


@pytest.mark.parametrize("seed", range(4))
def test_packing_plan(seed):
    rng = np.random.default_rng(seed)
    sizes = np.minimum(2048, rng.lognormal(5 + seed / 2, 1.2, 3000).astype(int) + 1)
    h = np.bincount(sizes, minlength=2049)
    plan = packing.plan(h)
    load, seen = collections.Counter(), np.zeros(2049, int)
    for v, first, ranks, each, seq, offset in sorted(plan):
        assert first == seen[v]
        seen[v] += ranks
        for k in range(ranks // each):
            load[seq + k] += each * v
            assert offset + each * v <= 2048
    assert (seen == h).all() and max(load.values()) <= 2048
    assert len(load) <= 1.05 * max(-(-sizes.sum() // 2048), (sizes > 1024).sum()) + 1


def sets_of(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def classes(ids, texts):
    sets = [sets_of(t) for t in texts]
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(x, least.get(find(i), x))
    return collections.Counter((x, len(sets[i]), least.get(find(i)) if sets[i] else x) for i, x in enumerate(ids))


def test_ngram_join(docs, none):
    assert ngram_join.join_components(none).count() == 0
    rows = docs.collect()
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join_components(docs).collect())
    assert got == classes([r.doc_id for r in rows], [r.text for r in rows])
    kept = ngram_join.first_rows(docs)
    assert kept.columns == docs.columns and 12 not in {r.doc_id for r in kept.collect()} and {4, 5} <= {r.doc_id for r in kept.collect()}


def test_ngram_join_chains(spark):
    """Groups whose members drift away from one another, so links form chains and no single centre."""
    rng = np.random.default_rng(1)
    texts = []
    for base in range(6):
        w = [f"b{base}w{i}" for i in range(120)]
        for _ in range(25):
            texts.append(" ".join(w))
            if rng.random() < 0.3:
                texts.append(texts[-1])
            w = list(texts[int(rng.integers(max(0, len(texts) - 12), len(texts)))].split())
            for k in rng.integers(0, 120, rng.integers(1, 4)):
                w[k] = f"e{rng.integers(1 << 30)}"
    ids = rng.permutation(len(texts)).tolist()
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join_components(df).collect()) == classes(ids, texts)


def test_ngram_join_hot_buckets(spark, monkeypatch):
    """Texts that share a passage in their prefixes, in buckets that are cut by a second shingle and in whole ones."""
    rng = np.random.default_rng(4)
    shared = " ".join(f"s{i}" for i in range(12))
    texts = []
    for k in range(30):
        own = [f"o{k}x{i}" for i in range(int(rng.integers(0, 14)))]
        for _ in range(int(rng.integers(1, 5))):
            w = list(own)
            if w and rng.random() < 0.5:
                w[int(rng.integers(len(w)))] = f"e{rng.integers(1 << 30)}"
            texts.append(f"{shared} {' '.join(w)}")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for hot in (3, 10_000):
        monkeypatch.setattr(ngram_join, "HOT", hot)
        got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join_components(df).collect())
        assert got == classes(range(len(texts)), texts)


def test_first_rows(spark, none):
    """Rows are judged, not ids: repeated and null ids keep one row of each group, through a broadcast and through a shuffle."""
    other = "an entirely different sentence about boats that sail over the calm sea at night while we sleep"
    rows = [(1, BASE, 0), (5, BASE, 1), (5, other, 2), (3, BASE, 3), (3, BASE, 4), (None, LONG, 5), (None, LONG, 6), (None, LONG + " end", 7), (None, "", 8), (None, None, 9), (2, " ", 10), (2, " ", 11)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k int").withColumns({c: F.lit("x") for c in ["_row", "_file", "_place", "id", "hi", "node"]})
    for few in (1000, 0):
        mp = pytest.MonkeyPatch()
        mp.setattr(ngram_join, "FEW", few)
        for x in (df, stage(df.repartition(4), "in"), stage(df, "in").filter("k >= 0")):
            kept = ngram_join.first_rows(x)
            got = {r.k for r in kept.collect()}
            assert kept.columns == df.columns and got - {5, 6, 7} == {0, 2, 8, 9, 10, 11} and len(got) == 7
        mp.undo()
    assert ngram_join.first_rows(none).count() == 0 and ngram_join.first_rows(none).columns == none.columns


@pytest.mark.parametrize("weight", [200_000, 700])
def test_ngram_join_links(spark, docs, none, monkeypatch, weight):
    """Every row's links are counted, copies and links within a component too, in one block or many."""
    monkeypatch.setattr(ngram_join, "WEIGHT", weight)
    assert ngram_join.join_links(none).count() == 0
    rng = np.random.default_rng(2)
    texts = [r.text for r in docs.collect()]
    for base in range(2):
        w = [f"b{base}w{i}" for i in range(100)]
        for _ in range(40):
            near = list(w)
            for k in rng.integers(0, 100, rng.integers(0, 4)):
                near[k] = f"e{rng.integers(1 << 30)}"
            texts.append(" ".join(near))
    every = [sets_of(t) for t in texts]
    want = {i: sum(i != j and len(a) > 0 and 100 * len(a & b) >= 80 * len(a | b) for j, b in enumerate(every)) for i, a in enumerate(every)}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_links for r in ngram_join.join_links(df).collect()} == want


def test_shards(spark, docs, none, tmp_path):
    """Slots are the permuted places of the records in the input, however it is dealt out; all ids come back."""
    assert shards.materialise(none, str(tmp_path / "none")).count() == 0
    tok = tokens.WordIds(tokens.vocabulary()).tok
    given = [(r.doc_id, r.text) for r in docs.collect()] * 2
    records = []
    for doc, text in given:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        records += [(doc, k // 64, ids[k : k + 64]) for k in range(0, len(ids), 64)]
    slots = shards.permute(np.arange(len(records), dtype=np.uint64), len(records)).tolist()
    want = {s: r for s, r in zip(slots, records, strict=True)}
    for parts in (1, 3, 17):
        df = spark.createDataFrame(spark.sparkContext.parallelize(given, parts), "doc_id long, text string").withColumns({"path": F.lit(1), "first": F.lit(2), "_metadata": F.lit(3)})
        to = str(tmp_path / f"in{parts}")
        rows = shards.materialise(df, to, stride=64, per_shard=100).collect()
        back = shards.read_slots(to, 0, len(rows) + 5, 100, 64)
        assert sorted(r.slot for r in rows) == list(range(len(records))) and len(back) == len(rows)
        assert {r.slot: (r.doc_id, r.piece, back[r.slot][: r.length].tolist()) for r in rows} == want
        assert all(zlib.crc32(back[r.slot].tobytes()) == r.ids_crc32 and not back[r.slot][r.length :].any() for r in rows)
        assert all(r.shard == r.slot // 100 and r.byte_offset == r.slot % 100 * 128 for r in rows)
        assert (back[5:250] == shards.read_slots(to, 5, 245, 100, 64)).all()


def test_shards_splits(spark, tmp_path):
    """One file, read in one and in many splits, gives the same slots."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("word"), F.col("id").cast("string"), F.lit(" ")), 5).alias("text"))
    df.coalesce(1).write.option("parquet.block.size", 1024).parquet(str(tmp_path / "in"))
    got, tasks = [], set()
    for size in ("128m", "8k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        one = spark.read.parquet(str(tmp_path / "in"))
        tasks.add(one.rdd.getNumPartitions())
        got.append({(r.doc_id, r.piece, r.slot) for r in shards.materialise(one, str(tmp_path / size), per_shard=500).collect()})
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got[0] == got[1] and len(tasks) == 2


@pytest.mark.parametrize("size", [1, 2, 7, 1000, 4097])
def test_permute(size):
    got = shards.permute(np.arange(size, dtype=np.uint64), size)
    assert sorted(got.tolist()) == list(range(size))
    if size > 100:
        assert (got != shards.permute(np.arange(size, dtype=np.uint64), size, key=1)).any()


def test_decontaminate(spark, docs, none, bench):
    assert decontaminate.overlaps(none, bench, ["doc_id"]).count() == 0
    assert decontaminate.overlaps(docs, bench.limit(0), ["doc_id"]).count() == 0
    found = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, bench, ["doc_id"]).collect()}
    assert found == {(17, 1), (18, 1)}
    kept = decontaminate.clean_rows(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(TEXTS) - 2


def test_decontaminate_tolerance(spark, bench):
    """Any two substitutions in thirteen words are found, three spread over a short passage are not."""
    w = BENCH.split()[:13]
    rng = np.random.default_rng(0)
    cases = [[int(i) for i in rng.choice(13, 2, replace=False)] for _ in range(60)] + [[2, 6, 10]]
    texts = [" ".join(["u", "v"] + [f"z{i}" if i in c else x for i, x in enumerate(w)] + ["q"] * 15) for c in cases]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in decontaminate.overlaps(df, bench, ["doc_id"]).collect()} == set(range(60))


def test_decontaminate_brute(spark):
    """All windows that agree well enough, for items of every length, repeated words and repeated rows included."""
    rng = np.random.default_rng(6)
    draw = lambda n: [str(x) for x in rng.choice(list("abcdefghij"), n)]
    items = [draw(int(n)) for n in rng.integers(2, 30, 25)] + [["so"] * 9, ["so"] * 40]
    texts = []
    for _ in range(60):
        w = list(items[int(rng.integers(len(items)))])
        for k in rng.integers(0, len(w), int(rng.integers(0, 4))):
            w[int(k)] = "zz"
        cut = int(rng.integers(0, 3))
        texts.append(draw(int(rng.integers(0, 8))) + w[cut:] + draw(int(rng.integers(0, 8))))
    texts += [["so"] * 300, texts[0]]
    want = {}
    for i, d in enumerate(texts):
        for j, b in enumerate(items):
            n = min(13, len(b))
            least = n - (2 if len(b) >= 12 else 1 if len(b) >= 8 else 0)
            for at in range(len(b) - n + 1):
                for p in range(len(d) - n + 1):
                    same = sum(x == y for x, y in zip(b[at : at + n], d[p : p + n], strict=True))
                    if len(b) >= 4 and same >= least:
                        old = want.get((i, j), (p, 0))
                        want[i, j] = (min(p, old[0]), max(same, old[1]))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(j, " ".join(w)) for j, w in enumerate(items)], "item_id long, text string")
    rows = decontaminate.overlaps(df.unionByName(df.limit(3)), bench.unionByName(bench), ["doc_id"]).collect()
    assert {(r.doc_id, r.item_id): (r.first_word, r.matched_words) for r in rows} == want and len(rows) == len(want)


def test_decontaminate_native(spark, docs, bench):
    """No Python on the path, and no join or aggregate expression that the optimizer repeats as a filter."""
    plan = decontaminate.overlaps(docs, bench, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapIn" not in plan and plan.count("zip_with") <= 40


def test_urls(spark):
    rng = np.random.default_rng(0)
    hosts = ["com", "a.com", "b.a.com", "c.b.a.com", "x.net", "net", "a..com", ".com", "example.org"]
    paths = ["", "/", "/en", "/en/", "/en/x", "/fr/", "/en/x/y"]
    rules = [(str(rng.choice(["allow", "block"])), h, p) for h in hosts[:6] for p in paths[1:6] if rng.random() < 0.5]
    bad = [None, "", "no scheme", "http://", "://", "HTTP://A.COM/En/?q#f", "http://a.com?x/en/", "http://a.com#/en/"]
    good = [f"http://{h}{p}{q}" for h in hosts for p in paths for q in ("", "?a=/en/", "#t")]
    rows = [(i, u) for i, u in enumerate(bad + good * 3)]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit(1), "verdict": F.lit(2)}).repartition(5)
    lists = spark.createDataFrame(rules, "verdict string, host string, path string")

    def judge(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match("[^/?#]*", rest).group()
        path = re.match("[^?#]*", rest[len(host) :]).group()
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fit = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=None)
        return host, path, best and best[2], best[3] if best else "allow"

    want = {i: judge(u) for i, u in rows}
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(df, lists, "page_id").collect()}
    assert got == want
    for tasks in (1, 40):  # one range, and more ranges than hosts
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
        assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(df, lists, "page_id").collect()} == want
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert urls.filter_urls(df.withColumn("page_id", F.lit(None).cast("long")), lists, "page_id").count() == len(rows)
    assert urls.filter_urls(df.limit(0), lists, "page_id").count() == 0
    assert {r.verdict for r in urls.filter_urls(df, lists.limit(0), "page_id").collect()} == {"allow"}


def test_token_counts(docs, none):
    assert counts.token_counts(none).count() == 0
    model = counts.unigram(tokens.vocabulary("piece_bpe_32k.model"))

    def plain(word):
        best = [(0, 0)]
        for i in range(1, len(word) + 1):
            n = len(word[i - 1].encode())
            ways = [(best[j][0] + model.score[word[j:i]], best[j][1] - 1) for j in range(i) if word[j:i] in model.score]
            if word[i - 1] not in model.score:
                ways.append((best[i - 1][0] + n * model.byte, best[i - 1][1] - n))
            best.append(max(ways))
        return -best[-1][1]

    want = collections.Counter()
    known = {}
    for r in docs.collect():
        found = WORD.findall(r.text or "")
        known |= {w: plain("▁" + w) for w in set(found) - set(known)}
        want[r.doc_id, len(found), sum(map(known.__getitem__, found))] += 1
    assert want == collections.Counter((r.doc_id, r.n_words, r.n_tokens) for r in counts.token_counts(docs).collect())


def kneser_ney(words):
    """Interpolated Kneser-Ney of order 4 from dictionaries: p(context, character)."""
    grams = collections.Counter()
    for w in words:
        x = ["<"] * 3 + list(w) + [">"]
        grams.update(tuple(x[i - 3 : i + 1]) for i in range(3, len(x)))
    levels = [grams]
    for _ in range(3):
        levels.append(collections.Counter(g[1:] for g in levels[-1]))
    levels = levels[::-1]
    discount = []
    for c in levels:
        n = collections.Counter(c.values())
        discount.append(n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5)
    letters = {g[0] for g in levels[0]}

    def p(context, x, n=4):
        if n == 0:
            return 1 / (len(letters) + 1)
        context = context[len(context) - (n - 1) :]
        here = {g: c for g, c in levels[n - 1].items() if g[:-1] == context}
        lower = p(context, x, n - 1)
        if not here:
            return lower
        total, d = sum(here.values()), discount[n - 1]
        own = here.get((*context, x))
        return (own - d if own else 0) / total + d * len(here) / total * lower

    return p, letters


def test_language_model():
    """Probabilities are those of a plain restatement, and add up to one over all characters and an unknown one."""
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcd\U0001F600"), int(rng.integers(1, 7)))) for _ in range(200)]
    k, n = np.unique(langid.grams(words)[0], return_counts=True)
    model = langid.Model(k, n)
    p, letters = kneser_ney(words)
    code = lambda x: {"<": langid.START, ">": langid.END}.get(x, 0xD800 + (ord(x) & 0x7FF) if ord(x) > 0xFFFF else ord(x))
    contexts = [("<", "<", "<"), ("<", "<", "a"), ("a", "b", "c"), ("z", "z", "z"), ("z", "a", "b"), ("d", "d", "\U0001F600")]
    for c in contexts:
        every = [*sorted(letters), "z"]
        packed = [sum(code(x) << 16 * (3 - i) for i, x in enumerate((*c, e))) for e in every]
        got = np.exp(model.log_p(np.array(packed, np.uint64)))
        assert np.allclose(got, [p(c, e) for e in every], rtol=1e-9) and abs(got.sum() - 1) < 1e-9
    h, chars = langid.entropies(["ab cda", None, "a"], [model])
    plain = lambda w: sum(np.log(p(tuple((["<"] * 3 + list(w))[i : i + 3]), x)) for i, x in enumerate([*w, ">"]))
    assert np.allclose(h[[0, 2], 0], [-(plain("ab") + plain("cda")) / 7, -plain("a") / 2]) and chars.tolist() == [7, 0, 2]


def test_language_id(spark, docs, none):
    assert langid.identify(none).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert got[4].lang_pred == got[5].lang_pred == got[9].lang_pred == "und" and got[4].score == 0.0
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(df).join(df.select("doc_id", "lang", "n_chars"), "doc_id").filter("held_out AND n_chars > 50").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98
    assert all(0 <= r.score <= 1 for r in rows) and all((r.score < 0.5) >= r.rejected for r in rows)
    assert max(r.score for r in rows) - min(r.score for r in rows) > 0.02
    odd = df.limit(5).select("doc_id", F.lit("xqzj vkkw zzqx jjqv wvkx qqzz xkcd vvwq").alias("text"), "lang").withColumn("doc_id", -1 - F.col("doc_id")).withColumn("lang", F.lit(None).cast("string"))
    twice = df.select("doc_id", "text", "lang").unionByName(df.select("doc_id", "text", "lang")).unionByName(odd)
    assert all(r.score < 0.5 and r.rejected for r in langid.identify(twice).filter("doc_id < 0").collect())
    assert langid.sample(twice, "doc_id", "text", "lang", 7).groupBy("label", "own").count().filter("count > 7").count() == 0
    rare = df.select("doc_id", "text", F.when(F.col("doc_id") == 2, "xx").alias("lang"))
    assert {r.lang_pred for r in langid.identify(rare).collect()} <= {"xx", "und"}


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("a &amp; b", "a & b"), ("<p>a<p>b", "a\n\nb"), ("<div>a</div><div>b</div>", "a\nb"), ("a<br>b<br><br>c", "a\nb\n\nc"),
        ("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>", "- a\n  - b\n  - c\n- d"), ("<ol><li>x<li>y</ol>", "1. x\n2. y"),
        ("<table><tr><th>Name<th>Q<tr><td>apple &amp; co<td>1</table>", "Name        Q\napple & co  1"),
        ("<p hidden>no<p style='display: none'>no<p>yes<script>var a='</p>';</script><!-- no -->", "yes"), ("<pre>a\n  b</pre>", "a\n  b"),
        ("<title>t</title><body>x", "x"), ("<b>a</b> <i>b</i>\n c", "a b c"), ("</p></td>x<td>y", "x\ny"), ("<a href='>'>z</a><unclosed", "z"), ("<div>" * 5000 + "deep", "deep"),
        ("<table><tr><td><p>one</p><p>two</p><ul><li>a<li>b</ul><td>x</table>", "one  x\n\ntwo\n\n- a\n- b"),
        ("<table><tr><td colspan=2>ab<td>c<tr><td>d<td>e<td>f<tr><td rowspan=2>g<td>h<td>i<tr><td>j<td>k</table>", "ab    c\nd  e  f\ng  h  i\n   j  k"),
        (f"<table><tr><td><p>{'w' * 50}<p>b<td>c</table>", f"{'w' * 50}\n\nb\nc"), ("a&nbsp;&nbsp;b", "a  b"), ("<a title=it's>x</a> y's", "x y's"),
        ("<style>@media print{p{display:none}} .x, #y{display:none} b.z{visibility:hidden} i{display:none} i{display:inline}</style><p>a<p class='q x'>b<p id=y>c<p><b class=z>d</b><i>e</i>", "a\n\ne"),
        ("<math>x</math> <svg><text>y</text></svg><object>z</object>", "x yz"), ("<p style='display:block'>a", "a"),
        ("<dl><dt>a<dd>b</dl>", "a\n  b"), ("1 < 2 & 3", "1 < 2 & 3"),
    ],
)
def test_html(page, text):
    assert html.html_text(page) == text


def test_html_round_trip(spark):
    """Blocks, lists and tables drawn at random come back as they were set."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefg<&"), 4))
    esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;")
    pages, want = [], []
    for _ in range(50):
        page, blocks = "<html><head><title>no</title></head><body>", []
        for _ in range(int(rng.integers(1, 6))):
            kind, items = rng.integers(3), [word() for _ in range(int(rng.integers(1, 4)))]
            if kind == 0:
                page += f"<p>{esc(' '.join(items))}"
                blocks.append(" ".join(items))
            elif kind == 1:
                page += "<ul>" + "".join(f"<li>{esc(x)}" for x in items) + "</ul>"
                blocks.append("\n".join(f"- {x}" for x in items))
            else:
                page += "<table>" + "".join(f"<tr><td>{esc(x)}<td>{esc(x)}" for x in items) + "</table>"
                blocks.append("\n".join(f"{x}  {x}" for x in items))
        pages.append(page)
        want.append("\n\n".join(blocks))
    df = spark.createDataFrame([*enumerate(pages), (None, None)], "page_id long, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    assert [got[i] for i in range(len(pages))] == want and got[None] == ""
    assert html.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["", None, "plain words, It's 42 don't", "Ünïcödé Σίσυφος ΑΣ", "a\x1cb\x85c d", "<|endoftext|> x <|y|>", "İstanbul ﬁ ½ ²", "x" * 5000, "tab\tand\r\nline"])
def test_word_ids(text):
    table = tokens.WordIds(tokens.vocabulary(), keep=3)
    assert np.frombuffer(table.text(text), "<u4").tolist() == table.tok.encode(text or "", add_special_tokens=False).ids


def test_pipeline(spark):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "pii", "best_fit_packing"]
    rows = cp.run(spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    good = {r.doc_id for r in quality.quality(spark.read.parquet(f"{SF}/documents.parquet")).filter("kept").collect()}
    want = {c for _, _, c in classes(sorted(good), [docs[i] for i in sorted(good)])}
    bench = [re.findall(r"[^\W_]+", r.text.lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {tuple(b[i : i + 11]) for b in bench for i in range(len(b) - 10)}

    def leaks(t):
        w = re.findall(r"[^\W_]+", t.lower())
        return any(tuple(w[i : i + 11]) in grams for i in range(len(w) - 10))

    assert {r.doc_id for r in rows} == {i for i in want if not leaks(docs[i])}
    assert max(r.offset + r.length for r in rows) <= 2048
