"""Names (fingerprints) of byte strings by doubling: the name of 2h bytes is made from the names of both halves.

Names are 64 bits. Those of single bytes are random; each doubling multiplies by a constant that is
3 modulo 4, so periodic texts keep all their bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = np.random.default_rng(20240301).integers(1, 1 << 61, 64, dtype=np.uint64) * np.uint64(4) + np.uint64(3)
_B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Positions worked on at once, so that arrays stay in the processor's cache.
PIECE = 1 << 14


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def pair(x: np.ndarray, y: np.ndarray, step: int) -> np.ndarray:
    """Name of an ordered pair of names."""
    out = x * _STEP[step]
    out += y
    return out


def doubled(data: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """Names at every position that has so many bytes, for sizes that are powers of two."""
    out, names, h, step = {}, _TABLE[data], 1, 0
    while True:
        if h in sizes:
            out[h] = names
        if h == max(sizes):
            return [out[s] for s in sizes]
        names, step = pair(names[: max(0, len(names) - h)], names[h:], step), step + 1
        h *= 2


def leftmost_minima(x: np.ndarray, width: int) -> np.ndarray:
    """For every run of `width` values, the place of its smallest, by 48 bits; the leftmost of equals."""
    n = len(x) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = (x & np.uint64(0xFFFFFFFFFFFF0000)) | np.arange(len(x), dtype=np.uint64)
    h = 1
    while 2 * h <= width:
        low, h = np.minimum(low[:-h], low[h:]), 2 * h
    if h < width:
        low = np.minimum(low[: h - width], low[width - h :])
    return (low[:n] & np.uint64(0xFFFF)).astype(np.int64)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string or binary column and where each text starts, with the end of the last; null is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        column = pc.fill_null(column.cast(pa.large_binary()), b"")
    else:
        column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batches, column: int, limit: int = 2 << 20) -> Iterator:
    """Parts of Arrow batches with about so many bytes of text, so that arrays with an entry for each byte or word stay small."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes)
        a = 0
        while a < len(sizes):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + limit, "right")))
            yield batch.slice(a, b - a)
            a = b


def pieces(data: np.ndarray, reach: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first position, positions, bytes): positions in turn, with the bytes that reach beyond them."""
    for a in range(0, len(data), PIECE):
        n = min(PIECE, len(data) - a)
        yield a, n, data[a : a + n + reach]


_POWER = np.uint64(0x9E3779B97F4A7C13)
_UNPOWER = np.uint64(pow(int(_POWER), -1, 1 << 64))
_WORD_PIECE = 1 << 18
_POWERS = np.cumprod(np.r_[np.uint64(1), np.full(_WORD_PIECE, _POWER, np.uint64)], dtype=np.uint64)
_UNPOWERS = np.cumprod(np.r_[np.uint64(1), np.full(_WORD_PIECE, _UNPOWER, np.uint64)], dtype=np.uint64)
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_FOLDED = _TABLE.copy()
_FOLDED[65:91] = _TABLE[97:123]


def word_names(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the words of every text, A-Z as a-z, and where each text's words start, with the end of the last."""
    fresh = np.zeros(len(data) + 1, bool)
    fresh[at] = True
    names, starts, a = [], [], 0
    while a < len(data):
        b = min(a + _WORD_PIECE, len(data))
        if b < len(data):  # end at a space or where a text starts
            cut = np.flatnonzero(_SPACE[data[a:b]] | fresh[a + 1 : b + 1])
            b = a + int(cut[-1]) + 1 if len(cut) else b
            if not len(cut):  # one word that is longer than a piece
                more = np.flatnonzero(_SPACE[data[b:]] | fresh[b + 1 :])
                b = b + int(more[0]) + 1
        part, solid = data[a:b], ~_SPACE[data[a:b]]
        new = solid.copy()
        new[1:] &= ~solid[:-1] | fresh[a + 1 : b]
        first = np.flatnonzero(new)
        if len(first):
            stop = np.flatnonzero(solid & np.r_[~solid[1:] | fresh[a + 1 : b], True]) + 1
            size = stop - first
            if len(part) <= _WORD_PIECE:
                total = np.cumsum(np.r_[np.uint64(0), _FOLDED[part] * _POWERS[: len(part)]], dtype=np.uint64)
                name = (total[stop] - total[first]) * _UNPOWERS[first]
            else:
                powers = np.cumprod(np.full(len(part), _POWER, np.uint64), dtype=np.uint64) * _UNPOWER
                total = np.cumsum(np.r_[np.uint64(0), _FOLDED[part] * powers], dtype=np.uint64)
                name = (total[stop] - total[first]) * np.array([pow(int(_UNPOWER), int(x), 1 << 64) for x in first], np.uint64)
            names.append(mixed(name ^ mixed(size.astype(np.uint64))))
            starts.append(first + a)
        a = b
    if not names:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    return np.concatenate(names), np.searchsorted(np.concatenate(starts), at)


def shingle_sets(names: np.ndarray, at: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For every text its sorted distinct names of `width` words in a row; with fewer words, of all its words."""
    run = names.copy()
    for k in range(1, width):
        run = pair(run[: len(names) - k], names[k:], 30 + k)
    run = mixed(run)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(run[a : b - width + 1])
        elif b > a:
            whole = names[a : a + 1]
            for k in range(1, b - a):
                whole = pair(whole, names[a + k : a + k + 1], 40 + k)
            yield mixed(whole)
        else:
            yield names[:0]
