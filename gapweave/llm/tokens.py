"""Token ids of whole texts by a public tokenizer, one encoding per distinct piece.

The tokenizer splits lower-cased text into pieces (letters, digits, signs) and
encodes each on its own, so a text's ids are those of its pieces, one after the
other; each worker keeps those it has met, in two generations of bounded size.
Texts with characters beyond the plain ones go word by word through the whole
tokenizer, which drops white space and never joins symbols across it.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

#: Entries in each of a worker's two generations, of words and of pieces; bounds its memory, not its results.
CACHE_WORDS = 300_000
#: Texts of printable ASCII, blanks, line feeds and Latin-1 letters: one normal form, one lower case, no marks.
PLAIN = re.compile("[\n -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
#: Fixed value: the split pattern of the vocabulary file, for such texts in lower case.
PRETOKEN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^ \na-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
LONG = 200


def byte_letters() -> dict[int, str]:
    """Latin-1 letters as the vocabulary spells their UTF-8 bytes: printable bytes stand
    for themselves, the others for the code points from 256 on, in order."""
    shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    spelt = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return {c: "".join(spelt[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


class Generations(dict):
    """A dict that computes missing values by `make` and forgets those not met of late."""

    def __init__(self, make, keep: int):
        super().__init__()
        self.make, self.keep, self.old = make, keep, {}

    def __missing__(self, key: str) -> bytes:
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(key) <= LONG:
            if len(self) >= self.keep:
                self.old = dict(self)
                self.clear()
            self[key] = got
        return got


class WordIds:
    """Ids of words and texts as little-endian bytes of `dtype`."""

    def __init__(self, file: str, dtype: str = "<u4", keep: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tok, self.dtype = Tokenizer.from_file(file), np.dtype(dtype)
        self.model, self.letters = self.tok.model, byte_letters()
        if self.tok.get_vocab_size() - 1 > np.iinfo(self.dtype).max:
            raise ValueError(f"{file}: ids do not fit {dtype}")
        self.one = [i.to_bytes(self.dtype.itemsize, "little") for i in range(self.tok.get_vocab_size())]
        self.pieces, self.words = Generations(self.piece, keep), Generations(self.word, keep // 4)

    def piece(self, piece: str) -> bytes:
        got = self.model.tokenize(piece if piece.isascii() else piece.translate(self.letters))
        return self.one[got[0].id] if len(got) == 1 else b"".join([self.one[t.id] for t in got])

    def word(self, word: str) -> bytes:
        return np.array(self.tok.encode(word, add_special_tokens=False).ids, self.dtype).tobytes()

    def text(self, text: str | None) -> bytes:
        """The ids of a whole text; none for null or blank text."""
        text = text or ""
        if "<|" not in text and PLAIN.fullmatch(text):
            return b"".join(map(self.pieces.__getitem__, PRETOKEN.findall(text.lower())))
        return b"".join(map(self.any_word, text.replace("\n", " ").split(" ")))

    def any_word(self, word: str) -> bytes:
        if "<|" not in word and PLAIN.fullmatch(word):
            return b"".join(map(self.pieces.__getitem__, PRETOKEN.findall(word.lower())))
        return self.words[word]


@lru_cache(maxsize=4)
def word_ids(file: str, dtype: str = "<u4") -> WordIds:
    """This process's table for a vocabulary file, shared by its tasks."""
    return WordIds(file, dtype)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
