"""Whole batches of texts as code-point arrays, for the operators that work in numpy."""

import ctypes
import hashlib
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Code points handled at once; texts are never cut, a longer one is a slice of its own.
SLICE_CHARS = 1 << 18
_ODD = 0x9E3779B97F4A7C15


def release() -> None:
    """Hands freed memory back to the system, so that a worker that lives for many tasks stays as large as one task needs."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: What a worker process keeps between tasks: one thing for each name.
_KEPT: dict[str, object] = {}


def kept(name: str, make):
    """make(), once a worker process; everything kept under another name is given up first, so that a worker holds the needs of one operator."""
    if name not in _KEPT:
        give_up()
        _KEPT[name] = make()
    return _KEPT[name]


def give_up() -> None:
    """Lets go of what earlier operators have kept in this worker process."""
    if _KEPT:
        _KEPT.clear()
        release()


class Texts:
    """A string column whose rows become Python strings, null as empty, only when a run of them is asked for."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        self.column = column
        self.lengths = pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False) if len(column) else np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.column)

    def __getitem__(self, at: slice) -> list[str]:
        x, y, _ = at.indices(len(self))
        return [t or "" for t in self.column.slice(x, y - x).to_pylist()]

    def __iter__(self) -> Iterator[str]:
        for x, y in slices(self):
            yield from self[x:y]


def slices(texts: "list[str] | Texts", limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of texts with at most limit code points together, or of one longer text."""
    at = total = 0
    for i, n in enumerate(texts.lengths.tolist() if isinstance(texts, Texts) else map(len, texts)):
        if total and total + n > limit:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(texts):
        yield at, len(texts)


def batches(column: pa.Array | pa.ChunkedArray) -> Texts:
    return Texts(column)


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and where each text starts (one more at the end). Lone surrogates stay as they are."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), starts


@lru_cache(1)
def categories() -> np.ndarray:
    """For each code point: 0 other, 1 letter (L*), 2 number (N*), 3 white space."""
    table = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = 1
        elif kind == "N":
            table[cp] = 2
    # fixed values: the code points with the Unicode property White_Space
    for cp in [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]:
        table[cp] = 3
    return table


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Spans up to this length are hashed side by side, longer ones one by one.
_LONG = 48


def absorbed(h: np.ndarray, x: np.ndarray, odd: int) -> np.ndarray:
    """One more number in each hash. Not linear in the numbers, so that no pattern of them cancels out."""
    h = (h ^ x) * np.uint64(odd)
    return h ^ (h >> np.uint64(29))


def span_hashes(cp: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each span cp[a:b]: equal spans have equal ones wherever they stand."""
    n = b - a
    order = np.argsort(-n, kind="stable")
    size, at = n[order], a[order]
    one, two = mixed(size + 1), mixed(size + 0x5851F42D)
    live = np.searchsorted(-size, -np.arange(min(int(size[0]) if len(size) else 0, _LONG)), side="left")  # spans longer than i
    for i, m in enumerate(live.tolist()):
        x = cp[at[:m] + i].astype(np.uint64) + np.uint64(1)
        one[:m], two[:m] = absorbed(one[:m], x, _ODD), absorbed(two[:m], x, 0xD6E8FEB86659FD93)
    for i in range(int(np.searchsorted(-size, -_LONG, side="left"))):
        one[i], two[i] = np.frombuffer(hashlib.blake2b(cp[at[i] : at[i] + size[i]].astype("<u4").tobytes(), digest_size=16).digest(), "<u8")
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return mixed(one)[back], mixed(two)[back]
