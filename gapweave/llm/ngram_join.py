"""N-gram Jaccard join: documents whose sets of 5-word shingles have a similarity of 0.8 or more.

Equal sets are one class, told by 128 bits. A first exchange counts in how many
distinct sets each shingle occurs: a task sends the sets of each bucket of shingles
as one block, with copies left out, and gets back only shingles that other sets
share. A set with too few of those has no partner. The rest is ordered rare
shingles first, in ORDERS global orders that break ties by different hashes;
partners must share a shingle of their prefixes under every order. Candidates meet
by the first order's prefixes, those whose prefixes do not meet under each of the
others are dropped, and what is left is verified on whole sets.

Large groups cost no pairs within: in each prefix bucket sets are first held
against the most central one, and links make components. What is left are pairs of
sets in different components; a bucket of more than HOT sets is cut by a second
shared shingle, which every pair that links has. All of them are verified, so no
link between components is lost. join_links then counts the links of every row:
all pairs of distinct sets of a component are held against each other in cells of
two blocks of sets, and a linked set counts with all its copies, as do a row's own
copies.

Null, empty and blank texts have no shingles and link with nothing; a text of
fewer than five words is one shingle. Repeated texts and ids are rows of their own
and share a component; a null id has no say in the smallest id. An empty table
gives no rows. Other input columns are ignored. first_rows judges rows, not ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gapweave.llm.common import addressed, discard, few, lean, slices, stage, table, tasks_for
from gapweave.llm.components import components
from gapweave.llm.shingles import mix, shingle_sets

#: Two sets link if PART * |intersection| >= OF * |union|.
PART, OF = 100, 80
ORDERS = 3
#: Shingles that a task holds before it sends them.
HOLD = 500_000
#: Sets of a prefix bucket beyond which it is cut by a second shingle.
HOT = 500
#: Shingles of a component in a block, about; two blocks make a cell.
WEIGHT = 200_000
#: Rows that are dropped through a broadcast of their addresses; more of them go through a shuffle.
FEW = 4_000_000
TOKEN = np.uint64((1 << 56) - 1)
HEAD = (("hi", "<u8"), ("lo", "<u8"), ("n", "<u4"), ("k", "<u4"))
KEY = ["hi", "lo"]


def least_shared(n: np.ndarray) -> np.ndarray:
    """Shingles that a set of n must share with any partner."""
    return -(-OF * n // PART)


def set_ids(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set, 0 for an empty one: two sums of hashes of its shingles."""
    hi, lo = np.zeros(len(found), np.uint64), np.zeros(len(found), np.uint64)
    n = np.array([len(s) for s in found], np.int64)
    some = np.flatnonzero(n)
    if len(some):
        tokens = np.concatenate([found[i] for i in some])
        begin = np.concatenate([[0], np.cumsum(n[some])[:-1]])
        for out, salt in ((hi, 0x5851F42D4C957F2D), (lo, 0x14057B7EF767814F)):
            out[some] = mix(np.add.reduceat(mix(tokens ^ np.uint64(salt)), begin) + n[some].astype(np.uint64))
    return hi, lo


def texts_of(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of a batch, whose last column is a text, and their texts."""
    for some in slices(batch):
        yield some, some.column(batch.num_columns - 1).to_pylist()


def sets(df: DataFrame, keep: str, text: Column) -> DataFrame:
    """Rows (the columns `keep`, n_shingles, hi, lo), hi and lo null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for some, texts in texts_of(batch):
                found = shingle_sets(texts)
                n = np.array([len(s) for s in found], np.int64)
                ids = [pa.array(x.view(np.int64), pa.int64(), mask=n == 0) for x in set_ids(found)]
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array(n), *ids], [*some.schema.names[:-1], "n_shingles", *KEY])

    typed = df.select(*[c.split()[0] for c in keep.split(", ")], text.cast("string").alias("text"))
    return typed.mapInArrow(run, f"{keep}, n_shingles long, hi long, lo long")


def pack(head: dict[str, np.ndarray], tokens: np.ndarray, rank: np.ndarray | None = None) -> bytes:
    """Sets as bytes: their heads by column, their shingles in seven bytes each, and if given a rank in one byte."""
    parts = [len(head["k"]).to_bytes(8, "little"), len(tokens).to_bytes(8, "little"), *[head[c].astype(t).tobytes() for c, t in HEAD]]
    parts.append(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes())
    return b"".join(parts + ([rank.astype(np.uint8).tobytes()] if rank is not None else []))


def unpack(blob: bytes, ranked: bool = False) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray | None]:
    k, t = (int.from_bytes(blob[i : i + 8], "little") for i in (0, 8))
    head, at = {}, 16
    for c, kind in HEAD:
        head[c] = np.frombuffer(blob, kind, k, at)
        at += head[c].nbytes
    wide = np.zeros((t, 8), np.uint8)
    wide[:, :7] = np.frombuffer(blob, np.uint8, 7 * t, at).reshape(t, 7)
    return head, wide.view("<u8").ravel(), np.frombuffer(blob, np.uint8, t, at + 7 * t) if ranked else None


def joined(blobs: list[bytes], ranked: bool = False) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray | None]:
    """The blocks of a bucket as one."""
    parts = [unpack(b, ranked) for b in blobs]
    head = {c: np.concatenate([p[0][c] for p in parts]) for c, _ in HEAD}
    return head, np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]) if ranked else None


def distinct(head: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The first head of each set id, and for every head which of those it is."""
    order = np.lexsort((head["lo"], head["hi"]))
    hi, lo = head["hi"][order], head["lo"][order]
    new = np.ones(len(order), bool)
    new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return order[new], of


def by_bucket(head: dict[str, np.ndarray], tokens: np.ndarray, own: np.ndarray, bucket: np.ndarray, rank: np.ndarray | None = None) -> Iterator[tuple[int, bytes]]:
    """A block for each bucket; own: each shingle's set, as an index into the heads."""
    order = np.lexsort((own, bucket))
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for rows in np.split(order, cuts[1:]) if len(order) else []:
        kinds, k = np.unique(own[rows], return_counts=True)
        some = {c: head[c][kinds] for c in ("hi", "lo", "n")} | {"k": k}
        yield int(bucket[rows[0]]), pack(some, tokens[rows], rank[rows] if rank is not None else None)


def block_batches(found: Iterator[tuple[int, bytes]], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    keys, blobs, size = [], [], 0
    for k, b in found:
        keys.append(k)
        blobs.append(b)
        size += len(b)
        if size > limit:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "block"])
            keys, blobs, size = [], [], 0
    if keys:
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "block"])


def buckets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """The blocks of each bucket of a task whose rows are sorted by bucket."""
    rows = ((k, b) for batch in batches for k, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
    for k, group in groupby(rows, lambda r: r[0]):
        yield k, [b for _, b in group]


def shared_shingles(df: DataFrame, text: Column, buckets: int) -> DataFrame:
    """Rows (bucket of set ids, block): for each set the shingles that other sets have too, with the rank of their frequency."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        seen: set[tuple[int, int]] = set()
        held: list[np.ndarray] = []
        ids: list[tuple[int, int]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            n = np.array([len(s) for s in held])
            tokens = np.concatenate(held) & TOKEN
            hi, lo = np.array(ids, np.uint64).T
            yield from block_batches(by_bucket({"hi": hi, "lo": lo, "n": n}, tokens, np.repeat(np.arange(len(held)), n), (mix(tokens) % np.uint64(buckets)).astype(np.int64)))

        size = 0
        for batch in batches:
            for _, texts in texts_of(batch):
                found = shingle_sets(texts)
                for s, i in zip(found, zip(*(x.tolist() for x in set_ids(found)), strict=True), strict=True):
                    if len(s) and i not in seen:
                        seen.add(i)
                        ids.append(i)
                        held.append(s)
                        size += len(s)
                        if size > HOLD:
                            yield from flush()
                            held, ids, size = [], [], 0
        if held:
            yield from flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for _, blobs in buckets_of(batches):
            head, tokens, _ = joined(blobs)
            own = np.repeat(np.arange(len(head["k"])), head["k"])
            once = np.zeros(len(head["k"]), bool)
            once[distinct(head)[0]] = True  # copies that several tasks sent
            keep = once[own]
            tokens, own = tokens[keep], own[keep]
            order = np.argsort(tokens, kind="stable")
            ends = np.flatnonzero(np.diff(tokens[order], append=np.uint64(1 << 63)))
            often = np.diff(ends, prepend=-1)
            df_ = np.repeat(often, often)
            rank = np.minimum(255, (8 * np.log2(df_)).astype(np.int64))
            some = order[df_ > 1]
            to = ((head["lo"] % np.uint64(buckets)).astype(np.int64))[own[some]]
            yield from block_batches(by_bucket(head, tokens[some], own[some], to, rank[df_ > 1]))

    kinds = "bucket long, block binary"
    dealt = df.select(text.cast("string").alias("text")).mapInArrow(send, kinds).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(count, kinds)


def order_key(k: int, tokens: np.ndarray) -> np.ndarray:
    """What breaks ties of frequency in the k-th global order."""
    return mix(tokens + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1))


def survivors(shared: DataFrame, buckets: int) -> DataFrame:
    """Sets that share enough to have a partner: rows node (a number), hi, lo, n, m (shared shingles), far (how uncommon
    they are), tokens (the shared ones, sorted), pre0 (the prefix under the first order and one shingle more), pre1, ... (prefixes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for _, blobs in buckets_of(batches):
            head, tokens, rank = joined(blobs, True)
            first, of = distinct(head)
            own = np.repeat(of, head["k"])
            n = head["n"][first].astype(np.int64)
            m = np.bincount(own, minlength=len(first))
            good = (m >= least_shared(n)) & (n >= 4)  # of fewer, only equal sets link
            order = np.argsort(own, kind="stable")
            begin = np.concatenate([[0], np.cumsum(m)])
            rows: list[tuple] = []
            for i in np.flatnonzero(good).tolist():
                at = order[begin[i] : begin[i + 1]]
                t, r = tokens[at], rank[at]
                p = int(m[i] - least_shared(n[i]) + 1)
                pre = [t[np.lexsort((order_key(k, t), r))[: p + (k == 0)]].astype(np.int64) for k in range(ORDERS)]
                far = float((n[i] - m[i]) / n[i] + (255 - r.mean()) / 255)
                rows.append((*(int(head[c][first[i]].view(np.int64)) for c in KEY), int(n[i]), int(m[i]), far, np.sort(t).tobytes(), *pre))
                if len(rows) == 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), *[pa.list_(pa.int64())] * ORDERS]
    names = ["hi", "lo", "n", "m", "far", "tokens", *[f"pre{k}" for k in range(ORDERS)]]
    dealt = shared.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    kinds = "hi long, lo long, n long, m long, far double, tokens binary, " + ", ".join(f"pre{k} array<bigint>" for k in range(ORDERS))
    return dealt.mapInArrow(run, kinds).withColumn("node", F.monotonically_increasing_id())


def prefixes(sets_: DataFrame) -> DataFrame:
    """Rows (token, node, n, far, rest): the prefix entries under the first order; rest: shared shingles from the entry on."""
    prefix = F.slice("pre0", F.lit(1), (F.col("m") - F.ceil(F.col("n") * OF / PART) + 1).cast("int"))
    one = sets_.select("node", "n", "m", "far", F.posexplode(prefix).alias("i", "token"))
    return one.select("token", "node", "n", "far", (F.col("m") - F.col("i")).alias("rest"))


def verify(pairs: DataFrame, sets_: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose prefixes meet under the other orders too and that link."""
    more = [f"pre{k}" for k in range(1, ORDERS)]
    side = lambda x: sets_.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("tokens").alias(f"t{x}"), *[F.col(c).alias(f"{c}{x}") for c in more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            na, nb = (batch.column(j).to_pylist() for j in (2, 4))
            ta, tb = batch.column(3), batch.column(5)
            keep = []
            for i in range(batch.num_rows):
                if PART * min(na[i], nb[i]) >= OF * max(na[i], nb[i]):
                    both = len(np.intersect1d(np.frombuffer(ta[i].as_buffer(), "<u8"), np.frombuffer(tb[i].as_buffer(), "<u8"), assume_unique=True))
                    if PART * both >= OF * (na[i] + nb[i] - both):
                        keep.append(i)
            if keep:
                yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(keep)) for k in (0, 1)], ["a", "b"])

    met = pairs.join(side("a"), "a").join(side("b"), "b")
    for c in more:
        met = met.filter(F.arrays_overlap(f"{c}a", f"{c}b"))
    return met.select("a", "b", "na", "ta", "nb", "tb").mapInArrow(run, "a long, b long")


def central_pairs(entries: DataFrame) -> DataFrame:
    """Each set with the most central set that its prefix buckets name most often."""
    hubs = entries.groupBy("token").agg(F.min(F.struct("far", "node")).alias("hub"), F.count("*").alias("k")).filter("k > 1").select("token", F.col("hub.node").alias("b"))
    named = entries.join(hubs, "token").filter("node <> b").groupBy("node", "b").agg(F.count("*").alias("k"))
    return named.groupBy("node").agg(F.max(F.struct("k", "b")).alias("best")).select(F.col("node").alias("a"), F.col("best.b").alias("b"))


def other_pairs(entries: DataFrame, sets_: DataFrame, roots: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All pairs of sets in different components whose prefixes meet under the first order and that could link by size
    and position; and the staged entries that they are made from."""
    own = entries.join(roots, "node", "left").select("token", "node", "n", "rest", F.coalesce("root", "node").alias("root"))
    mixed = own.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("k")).filter("x < y").select("token", (F.col("k") > HOT).alias("hot"))
    own = stage(own.join(mixed, "token").withColumn("second", F.lit(None).cast("long")), "mixed_buckets")
    # a pair that links shares at least four shingles: in a hot bucket also one behind the first that they share
    after = sets_.select("node", "pre0")
    cut = own.filter("hot").join(after, "node").select("token", "node", "n", "rest", "root", F.explode(F.expr("slice(pre0, array_position(pre0, token) + 1, size(pre0))")).alias("second"))
    all_ = own.filter("NOT hot").select("token", "node", "n", "rest", "root", F.lit(0).cast("long").alias("second")).unionByName(cut)
    a = all_.select("token", "second", F.col("node").alias("a"), F.col("n").alias("na"), F.col("rest").alias("ra"), F.col("root").alias("roota"))
    b = all_.select("token", "second", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("rest").alias("rb"), F.col("root").alias("rootb"))
    met = a.join(b, ["token", "second"]).filter(
        (F.col("a") < F.col("b")) & (F.col("roota") != F.col("rootb"))
        & (PART * F.least("na", "nb") >= OF * F.greatest("na", "nb"))
        & ((PART + OF) * F.least("ra", "rb") >= OF * (F.col("na") + F.col("nb")))
    )
    known = done.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return met.select("a", "b").distinct().join(known, ["a", "b"], "left_anti"), own


def set_links(df: DataFrame, text: Column) -> tuple[DataFrame, DataFrame]:
    """Rows (node, root): the sets that aren't the smallest node of their component, and that one; and the survivors."""
    buckets = tasks_for(df, 8 << 20)
    sets_ = stage(survivors(shared_shingles(df, text, buckets), buckets), "survivors")
    entries = stage(prefixes(sets_), "prefixes")
    tried = stage(central_pairs(entries), "central_pairs")
    links = stage(verify(tried, sets_), "links")
    roots = components(links)
    pairs, own = other_pairs(entries, sets_, roots, tried)
    more = stage(verify(pairs, sets_), "other_links")
    discard(entries, tried, links, own)
    if more.isEmpty():
        return roots, sets_
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)), sets_


def cell_links(n: list[int], tokens: list[np.ndarray], copies: list[int], block: list[int]) -> list[int]:
    """For each set of a cell, how many rows it links with: of the other block, or in a cell of one block of all other sets."""
    kinds, codes = np.unique(np.concatenate(tokens), return_inverse=True)
    sizes = np.array([len(t) for t in tokens])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    n_, c, side = np.array(n), np.array(copies), np.array(block)
    cross = len(set(block)) > 1
    out = []
    here = np.zeros(len(kinds), bool)
    for a in range(len(n)):
        mine = codes[begin[a] : begin[a + 1]]
        here[mine] = True
        both = np.add.reduceat(here[codes].astype(np.int64), begin[:-1])
        here[mine] = False
        good = PART * both >= OF * (n_[a] + n_ - both)
        good &= side != side[a] if cross else np.arange(len(n)) != a
        out.append(int(c[good].sum()))
    return out


def links_by_set(sets_: DataFrame, roots: DataFrame, copies: DataFrame) -> DataFrame:
    """Rows (hi, lo, linked): with how many rows of other sets each set of a component links. copies: rows (hi, lo, copies)."""
    tasks = tasks_for(sets_)
    members = roots.select("node", "root").unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    full = members.join(sets_.select("node", *KEY, "n", "m", "tokens"), "node").join(copies, KEY)
    large = full.groupBy("root").agg(F.sum("m").alias("k")).filter(F.col("k") > WEIGHT).withColumn("blocks", F.ceil(F.col("k") / WEIGHT).cast("int"))
    placed = full.join(stage(large, "large"), "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = cells.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "n", "copies", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        rows = (r for batch in batches for r in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        for (_, i, j), group in groupby(rows, lambda r: r[:3]):
            block, node, n, c, t = zip(*[r[3:] for r in group], strict=True)
            if i != j and len(set(block)) < 2:
                continue
            got = cell_links(n, [np.frombuffer(x, "<u8") for x in t], c, block)
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(got, pa.int64())], ["node", "linked"])

    dealt = cells.repartition(tasks, "root", "i", "j").sortWithinPartitions("root", "i", "j")
    linked = dealt.mapInArrow(run, "node long, linked long").groupBy("node").agg(F.sum("linked").alias("linked"))
    return linked.join(sets_.select("node", *KEY), "node").select(*KEY, "linked")


def classes(rows: DataFrame, sets_: DataFrame, roots: DataFrame, *found: Column) -> DataFrame:
    """Rows (hi, lo, root, and `found` aggregated over the rows of the set); root null for a set alone in its component."""
    per_set = rows.filter("n_shingles > 0").groupBy(*KEY).agg(*found)
    members = roots.select("node", "root").unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    return per_set.join(sets_.select("node", *KEY).join(members, "node").select(*KEY, "root"), KEY, "left")


def with_components(rows: DataFrame, sets_: DataFrame, roots: DataFrame, id_col: str, linked: DataFrame | None = None) -> DataFrame:
    """Every row's id, n_shingles and component_id, and if links by set are given its n_links."""
    per_set = stage(classes(rows, sets_, roots, F.min("id").alias("least"), F.count("*").alias("copies")), "classes")
    least = per_set.filter("root IS NOT NULL").groupBy("root").agg(F.min("least").alias("least_all"))
    of_set = per_set.join(least, "root", "left").select(*KEY, "copies", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("least_all")).alias("component_id"))
    out = [F.col("id").alias(id_col), "n_shingles", F.col("component_id")]
    if linked is not None:
        of_set = of_set.join(linked, KEY, "left")
        out.append((F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    found = rows.filter("n_shingles > 0").join(of_set, KEY).select(*out)
    alone = rows.filter("n_shingles = 0").select(F.col("id").alias(id_col), "n_shingles", F.col("id").alias("component_id"), *([F.lit(0).cast("long").alias("n_links")] if linked is not None else []))
    return found.unionByName(alone)  # rows without words meet no join, so they are no hot key


def set_rows(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Staged rows (id, n_shingles, hi, lo) of every row, the components and the survivors."""
    text = F.col(f"`{text_col}`")
    rows = stage(sets(df.select(F.col(f"`{id_col}`").cast("long").alias("id"), text), "id long", text), "sets")
    return rows, *set_links(df, text)


def join_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id, n_shingles and component_id, the smallest id that links reach."""
    rows, roots, sets_ = set_rows(df, id_col, text_col)
    return with_components(rows, sets_, roots, id_col)


def join_links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As join_components, and n_links: how many other rows each row links with."""
    rows, roots, sets_ = set_rows(df, id_col, text_col)
    copies = rows.filter("n_shingles > 0").groupBy(*KEY).agg(F.count("*").alias("copies"))
    linked = stage(links_by_set(sets_, roots, copies), "links_by_set")
    return with_components(rows, sets_, roots, id_col, linked)


def first_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group stays: the one with the smallest id, among rows of equal id any one of them.

    Rows are told apart by where they stand in their files, so repeated and null
    ids are rows like others; a group without any id keeps one row too. Rows
    without words all stay. Texts are not shuffled: the addresses of the rows to
    drop are broadcast as long as there are at most FEW of them, and beyond that
    they meet the rows in a shuffle.
    """
    at = addressed(df)
    text = F.col(f"_row.`{text_col}`")
    some = at.select(F.col(f"_row.`{id_col}`").cast("long").alias("id"), "_file", "_place", text.alias("text"))
    rows = stage(sets(some, "id long, _file long, _place long", F.col("text")), "sets")
    roots, sets_ = set_links(some, F.col("text"))
    place = F.struct(F.col("id").isNull().alias("x"), "id", *KEY, "_file", "_place")
    per_set = stage(classes(rows, sets_, roots, F.min(place).alias("least")), "classes")
    alone = per_set.filter("root IS NULL").select("least")
    stay = alone.unionByName(per_set.filter("root IS NOT NULL").groupBy("root").agg(F.min("least").alias("least")).select("least"))
    gone = rows.filter("n_shingles > 0").join(stay.select("least._file", "least._place"), ["_file", "_place"], "left_anti")
    gone = stage(gone.select("_file", "_place"), "gone")
    discard(rows, per_set, sets_)
    return at.join(few(gone, FEW), ["_file", "_place"], "left_anti").select("_row.*")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_links(table(spark, sf_dir, "documents"))
