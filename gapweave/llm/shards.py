"""Training-order materialisation of token ids as fixed-stride binary shards.

Each text's ids, closed by an end id, are cut into records of STRIDE ids, the last
one padded. A record's index is its place in the input: files by name, rows as they
stand in them, pieces in order. It comes from a staged table of compressed blocks of
ids, each a run of neighbouring rows, and running sums of their sizes, so it does
not depend on how the input is split into tasks, and texts are tokenized once. A
keyed Feistel permutation of the N indexes, cycle-walking back into them, gives each
record its global slot. SHARD slots in a row are a shard: a map task sends each
shard one compressed block, and a shard's task puts the records where they belong
and writes one file of equal records. Slot to file and byte is one division, and
reading is sequential and can resume anywhere.

A shard is written under a temporary name and moved into place, and its bytes are
a function of the input alone, so a task that is run again after a lost executor
leaves the same file. Null and empty texts are one record that holds the end id.
Repeated rows and ids are records of their own; a null id stays null in the
result. An empty table writes no shard. Other input columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gapweave.llm.common import discard, few, lean, read_from_files, shared_dir, slices, stage, table
from gapweave.llm.tokens import vocabulary, word_ids

STRIDE = 256
KEY = 20_240_229
#: Records of a shard, the last one of all aside.
SHARD = 1 << 15
#: Bytes of records that a task holds before it sends them.
HOLD = 8 << 20
NO_ID = -(1 << 63)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: xor-shifts and odd multipliers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, size: int, key: int = KEY, rounds: int = 6) -> np.ndarray:
    """A keyed permutation of range(size): a balanced Feistel network, applied again while outside."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for r in range(rounds):
            salt = np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & ((1 << 64) - 1))
            left, right = right, left ^ (mix(right ^ salt) & mask)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= np.uint64(size)]
    return out


def pack(docs: np.ndarray, pieces: np.ndarray, n: np.ndarray, ids: bytes, slots: np.ndarray | None = None) -> bytes:
    """Records as bytes: what is known of each, then all ids."""
    parts = [len(n).to_bytes(8, "little"), docs.astype("<i8").tobytes(), pieces.astype("<i4").tobytes(), n.astype("<i4").tobytes()]
    parts += [slots.astype("<i8").tobytes() if slots is not None else b"", ids]
    return zstandard.ZstdCompressor(level=6).compress(b"".join(parts))


def unpack(block: bytes, slotted: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]:
    """docs, pieces, lengths, slots if there are any, and all ids one after the other."""
    raw = zstandard.ZstdDecompressor().decompress(block)
    k = int.from_bytes(raw[:8], "little")
    docs, pieces, n = np.frombuffer(raw, "<i8", k, 8), np.frombuffer(raw, "<i4", k, 8 + 8 * k), np.frombuffer(raw, "<i4", k, 8 + 12 * k)
    at = 8 + 16 * k
    return docs, pieces, n, np.frombuffer(raw, "<i8", k, at) if slotted else None, np.frombuffer(raw, "<u2", -1, at + 8 * k * slotted)


def blocks(df: DataFrame, id_col: str, text_col: str, file: str, stride: int, end_id: int) -> DataFrame:
    """Rows (path, first, records, block): the records of neighbouring rows of a file, from row `first` on."""
    end = end_id.to_bytes(2, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        table = word_ids(file, "<u2")
        held: list[tuple[int, int, bytes]] = []
        path = first = following = None

        def send() -> pa.RecordBatch:
            docs, pieces, ids = zip(*held, strict=True)
            n = np.fromiter((len(x) // 2 for x in ids), np.int64, len(ids))
            block = pack(np.array(docs, np.int64), np.array(pieces, np.int32), n, b"".join(ids))
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([first], pa.int64()), pa.array([len(n)], pa.int64()), pa.array([block], pa.binary())], ["path", "first", "records", "block"])

        for some in (x for batch in batches for x in slices(batch)):
            for here, row, doc, text in zip(*(c.to_pylist() for c in some.columns), strict=True):
                if held and (here != path or row != following or len(held) * 2 * stride >= HOLD):
                    yield send()
                    held = []
                if not held:
                    path, first = here, row
                following = row + 1
                ids = table.text(text) + end
                held += [(NO_ID if doc is None else doc, i // (2 * stride), ids[i : i + 2 * stride]) for i in range(0, len(ids), 2 * stride)]
        if held:
            yield send()

    df = read_from_files(df)
    at = df.metadataColumn("_metadata")
    typed = df.select(at["file_path"].alias("path"), at["row_index"].alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return typed.mapInArrow(cut, "path string, first long, records long, block binary")


def materialise(
    df: DataFrame, to: str, id_col: str = "doc_id", text_col: str = "text", file: str | None = None, per_shard: int = SHARD,
    stride: int = STRIDE, key: int = KEY, end_id: int = 0,
) -> DataFrame:
    """Writes the shards below the folder `to`, which all executors share.

    Rows doc_id, piece, length, ids_crc32 (of the padded record), shard, slot, byte_offset.
    """
    spark = df.sparkSession
    cut = stage(blocks(df, id_col, text_col, file or vocabulary(), stride, end_id), "blocks")
    files, total = [], 0
    for path, n in sorted(tuple(r) for r in cut.groupBy("path").agg(F.sum("records")).collect()):  # a number per input file
        files.append((path, total))
        total += n
    inside = F.coalesce(F.sum("records").over(Window.partitionBy("path").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = cut.select("path", "first", "records").withColumn("inside", inside).join(F.broadcast(spark.createDataFrame(files, "path string, before long")), "path")
    bases = stage(bases.select("path", "first", (F.col("before") + F.col("inside")).alias("base")), "bases")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for base, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs, pieces, n, _, ids = unpack(block.as_buffer())
                slots = permute(np.arange(base, base + len(n), dtype=np.uint64), total, key).astype(np.int64)
                shard = slots // per_shard
                order, begin = np.lexsort((slots, shard)), np.concatenate([[0], np.cumsum(n)])
                cuts = np.flatnonzero(np.diff(shard[order], prepend=-1))
                out = [pack(docs[r], pieces[r], n[r], b"".join(ids[begin[i] : begin[i + 1]].tobytes() for i in r.tolist()), slots[r]) for r in np.split(order, cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(shard[order[cuts]], pa.int64()), pa.array(out, pa.binary())], ["shard", "block"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(to if "://" in to else f"file://{to}")
        store.create_dir(folder, recursive=True)
        rows = ((s, b.as_buffer()) for batch in batches for s, b in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
        for shard, group in groupby(rows, lambda r: r[0]):
            have = min(per_shard, total - shard * per_shard)
            out, known = np.zeros((have, stride), "<u2"), np.zeros((3, have), np.int64)
            for _, block in group:
                docs, pieces, n, slots, ids = unpack(block, True)
                place = slots - shard * per_shard
                known[:, place] = docs, pieces, n
                out.ravel()[np.repeat(place * stride - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(len(ids))] = ids
            name = f"{folder}/shard-{shard:08d}.bin"
            temporary = f"{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(temporary) as f:
                f.write(memoryview(out).cast("B"))
            store.move(temporary, name)
            crc = [zlib.crc32(x) for x in out]
            yield pa.RecordBatch.from_arrays(
                [pa.array(known[0], pa.int64(), mask=known[0] == NO_ID), pa.array(known[1].astype(np.int32)), pa.array(known[2].astype(np.int32)),
                 pa.array(crc, pa.int64()), pa.array(np.full(have, shard, np.int64)), pa.array(np.arange(have, dtype=np.int64) + shard * per_shard)],
                ["doc_id", "piece", "length", "ids_crc32", "shard", "slot"],
            )

    dealt = cut.join(few(bases), ["path", "first"]).select("base", "block").mapInArrow(deal, "shard long, block binary")
    kinds = "doc_id long, piece int, length int, ids_crc32 long, shard long, slot long"
    tasks = min(max(1, -(-total // per_shard)), 200_000)
    done = stage(dealt.repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(write, kinds), "records")
    discard(cut, bases)
    return done.select("doc_id", "piece", "length", "ids_crc32", "shard", "slot", (F.pmod("slot", F.lit(per_shard)) * (2 * stride)).alias("byte_offset"))


def read_slots(to: str, slot: int, n: int, per_shard: int = SHARD, stride: int = STRIDE) -> np.ndarray:
    """The n records from a global slot on, fewer at the end. For resumed readers."""
    from pyarrow import fs

    store, folder = fs.FileSystem.from_uri(to if "://" in to else f"file://{to}")
    out = [np.zeros((0, stride), "<u2")]
    while n > 0:
        name, place = f"{folder}/shard-{slot // per_shard:08d}.bin", slot % per_shard
        if store.get_file_info(name).type == fs.FileType.NotFound:
            break
        with store.open_input_file(name) as f:
            f.seek(place * 2 * stride)
            got = np.frombuffer(f.read(min(n, per_shard - place) * 2 * stride), "<u2").reshape(-1, stride)
        if not len(got):
            break
        out.append(got)
        slot, n = slot + len(got), n - len(got)
    return np.concatenate(out)


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}")
