"""Token counts of whole texts under a unigram vocabulary, by dynamic programming shared over a trie.

Pre-tokens are the blank-separated words, each led by the vocabulary's word mark.
The distinct ones of a block are inserted into a trie and the trie is walked once:
the best forward score of a node stands for all words that share its prefix, and a
word's last node holds its count. No vocabulary file at hand has unigram scores, so
they follow from the ranks of its pieces: rank r scores -round(10^6 ln(r + 2)), as
if frequency fell with the rank; characters without a piece fall back to their
bytes. The segmentation of the highest score counts, among equals the shortest.

Null and blank texts have no tokens. Words of more than LONG characters are scored
alone, in time linear in their length. Rows are counted one by one, so repeats, ties and skew change nothing.
An empty table gives no rows. Other input columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gapweave.llm.common import lean, slices, table
from gapweave.llm.tokens import vocabulary

WORD = re.compile("[^ \t\n\x0b\x0c\r]+")
MARK = "▁"
LONG = 200
#: Code points of text whose distinct words are in memory at once.
BLOCK = 16_000_000


class Unigram:
    """Scores of pieces, and the suffixes of pieces, which tell how far back to look."""

    def __init__(self, pieces: Iterable[tuple[int, str]]):
        self.score = {p: -round(1e6 * math.log(r + 2)) for r, p in pieces}
        self.byte = min(self.score.values(), default=0) * 2
        self.suffixes = {p[i:] for p in self.score for i in range(len(p))}

    def step(self, path: list[str], upto: list[tuple[int, int]]) -> None:
        """Adds to `upto`, for each prefix of `path` its best (score, -tokens), that of the whole path."""
        score, suffixes, at = self.score, self.suffixes, len(path) - 1
        best, sub = None, ""
        for j in range(at, -1, -1):
            sub = path[j] + sub
            if sub not in suffixes:
                break
            got = score.get(sub)
            if got is not None:
                s, c = upto[j]
                new = (s + got, c - 1)
                if best is None or new > best:
                    best = new
        if path[at] not in score:
            n = len(path[at].encode("utf-8", "surrogatepass"))
            s, c = upto[at]
            new = (s + n * self.byte, c - n)
            best = new if best is None else max(best, new)
        upto.append(best)

    def counts(self, words: Iterable[str]) -> dict[str, int]:
        """Tokens of each distinct word."""
        root: dict = {}
        found: dict[str, int] = {}
        for w in words:
            if len(w) > LONG:
                path, upto = [], [(0, 0)]
                for x in MARK + w:
                    path.append(x)
                    self.step(path, upto)
                found[w] = -upto[-1][1]
                continue
            node = root
            for x in MARK + w:
                node = node.setdefault(x, {})
            node[""] = w
        path, upto, todo = [], [(0, 0)], [(0, x, node) for x, node in root.items()]
        while todo:
            depth, x, node = todo.pop()
            del path[depth:], upto[depth + 1 :]
            path.append(x)
            self.step(path, upto)
            for y, below in node.items():
                if y:
                    todo.append((depth + 1, y, below))
                else:
                    found[below] = -upto[-1][1]
        return found


@lru_cache(maxsize=2)
def unigram(file: str) -> Unigram:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=file)
    plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return Unigram(enumerate(map(sp.id_to_piece, plain)))


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", file: str | None = None) -> DataFrame:
    """Every row's id, n_words and n_tokens."""
    file = file or vocabulary("piece_bpe_32k.model")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        model, block, size = unigram(file), [], 0

        def done() -> Iterator[pa.RecordBatch]:
            words: set[str] = set()
            for _, text in block:
                words.update(WORD.findall(text or ""))
            found = model.counts(words)
            rows = [(i, len(w := WORD.findall(text or "")), sum(map(found.__getitem__, w))) for i, text in block]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], [id_col, "n_words", "n_tokens"])

        for some in (x for batch in batches for x in slices(batch)):
            for row in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                block.append(row)
                size += len(row[1] or "")
                if size > BLOCK:
                    yield from done()
                    block, size = [], 0
        if block:
            yield from done()

    typed = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return typed.mapInArrow(count, f"`{id_col}` long, n_words long, n_tokens long")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
