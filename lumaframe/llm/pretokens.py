"""Splitting texts into the pieces that a byte-pair tokenizer encodes one by one, and encoding each distinct piece once.

Two fixed splits, those of the public vocabularies word_bpe_49k and byte_bpe_50k:
words: 's|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+ over text in NFC and lower case, white space dropped;
bytes: 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ over the text as it is.
"""

import unicodedata
from functools import cached_property, lru_cache

import numpy as np
from tokenizers import Tokenizer

from .codepoints import categories, codes, span_hashes


def folded(text: str) -> str:
    """NFC, then each character in lower case by itself (a final sigma is no special case)."""
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()


def split(texts: list[str], words: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, (start, end) of each piece, and the number of pieces before each text (one more at the end)."""
    cp, starts = codes(texts)
    n = len(cp)
    kind = np.append(categories()[cp], 9)
    first = np.zeros(n + 1, bool)
    first[starts] = True  # also where the last text ends
    begin = first.copy()
    begin[1:] |= kind[1:] != kind[:-1]
    if words:
        begin |= kind == 2
    else:
        # of a run of white space before something else the last one stands apart; a blank joins what follows
        last = np.flatnonzero((kind[:-1] == 3) & (kind[1:] != 3) & ~first[1:])
        begin[last] = True
        begin[last[cp[last] == 32] + 1] = False
    # contractions: an apostrophe that begins a piece takes s, t, m, d, re, ve or ll with it
    mark = np.flatnonzero((cp == 39) & begin[:-1])
    if len(mark):
        at = lambda i: np.where((i < n) & ~first[np.minimum(i, n)], cp[np.minimum(i, n - 1)], 0)
        one = at(mark + 1)
        two = np.where(one > 0, at(mark + 2), 0)
        single = np.isin(one, [115, 116, 109, 100])
        double = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
        begin[mark[single | double] + 1] = False
        begin[mark[single] + 2] = True
        begin[mark[double] + 3] = True
    begin[n] = True
    cuts = np.flatnonzero(begin)
    a, b = cuts[:-1], cuts[1:]
    if words:
        solid = kind[a] != 3
        a, b = a[solid], b[solid]
    return cp, a, b, np.searchsorted(a, starts)


def distinct(cp: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the pieces: two independent hashes of the distinct ones (two columns, by the first), where each first stands, which one each piece is, and counts."""
    one, two = span_hashes(cp, a, b)
    _, first, which, n = np.unique(one, return_index=True, return_inverse=True, return_counts=True)
    if (two[first][which] != two).any():  # pieces that only the second hash tells apart
        _, first, which, n = np.unique(np.stack([one, two], 1), axis=0, return_index=True, return_inverse=True, return_counts=True)
        which = which.reshape(-1)
    return np.stack([one[first], two[first]], 1), first, which, n


@lru_cache(1)
def unknown() -> np.ndarray:
    """Of each code point, whether it has no category yet."""
    return np.array([unicodedata.category(chr(cp)) == "Cn" for cp in range(0x110000)])


class Encoder:
    """A tokenizer file, applied to single pieces."""

    def __init__(self, path: str):
        self.path = path
        self.pieces = self._load()
        self.size = self.pieces.get_vocab_size()
        self.added = [t.content for t in self.pieces.get_added_tokens_decoder().values()]
        self.pieces.normalizer = None

    def _load(self) -> Tokenizer:
        t = Tokenizer.from_file(self.path)
        t.no_truncation()
        t.no_padding()
        return t

    @cached_property
    def whole(self) -> Tokenizer:
        """With its normalizer; only texts with an added token need it."""
        return self._load()

    def special(self, text: str) -> bool:
        """Texts with the string of an added token are encoded whole, as are those with a code point that Python's tables do not know: the tokenizer's may be newer."""
        return any(t in text for t in self.added) or (not text.isascii() and bool(unknown()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any()))

    def encode(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for x in range(0, len(pieces), 2000) for e in self.pieces.encode_batch_fast(pieces[x : x + 2000], add_special_tokens=False)]

    def encode_whole(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids


def ragged(pool: np.ndarray, offset: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The runs pool[offset:offset + length], one after the other."""
    ends = np.cumsum(length)
    return pool[np.repeat(offset - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]
