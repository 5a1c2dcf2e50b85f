"""Word shingles of whole texts as 64-bit hashes, by array arithmetic."""

from __future__ import annotations

from functools import lru_cache

ODD, UNDO = 0x9E3779B97F4A7C15, 0xF1DE83E19937733D  # an odd multiplier and its inverse modulo 2^64


@lru_cache(maxsize=1)
def byte_table():
    """A fixed pseudo-random 64-bit number for each byte, with A-Z as a-z."""
    import numpy as np

    table = mixed(np.arange(1, 257, dtype="u8") * np.uint64(ODD))
    table[65:91] = table[97:123]
    return table


def mixed(x):
    """A bijection of 64-bit integers that spreads each bit over all (in place)."""
    import numpy as np

    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(raw):
    """(hashes, ends): of each word of a byte array, words being runs without 0x20 and 0x09 to 0x0D; ends: byte after each word.

    A word's hash is that of its byte numbers weighted by powers of an odd number: prefix sums give all words at once.
    """
    import numpy as np

    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.concatenate(([True], space, [True])).astype("i1"))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, "u8"), ends
    values = byte_table()[raw]
    power = np.full(len(raw), ODD, "u8")
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    values *= power
    sums = np.concatenate((np.zeros(1, "u8"), np.add.accumulate(values)))
    undo = np.full(len(raw), UNDO, "u8")
    undo[0] = 1
    np.multiply.accumulate(undo, out=undo)
    hashes = (sums[ends] - sums[starts]) * undo[starts]
    hashes += (ends - starts).astype("u8") * np.uint64(0xD6E8FEB86659FD93)
    return mixed(hashes), ends


def shingle_sets(texts: list[bytes], width: int) -> list:
    """For each text the sorted distinct hashes of its `width`-word shingles; with fewer words, of the whole sequence; none without words."""
    import numpy as np

    raw = np.frombuffer(b"\n".join(texts), dtype="u1")  # a newline parts words as texts do
    hashes, ends = word_hashes(raw)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    cut = np.searchsorted(ends, bounds, side="left")
    out, start = [], 0
    if len(hashes) >= width:
        n = len(hashes) - width + 1
        windows = hashes[:n].copy()
        for k in range(1, width):
            windows *= np.uint64(ODD)
            windows += hashes[k : k + n]
        mixed(windows)
    for end in cut.tolist():
        if end - start >= width:
            out.append(np.unique(windows[start : end - width + 1]))
        elif end > start:
            whole = end - start
            for h in hashes[start:end].tolist():
                whole = (whole * ODD + h) % (1 << 64)
            out.append(mixed(np.array([whole], "u8")))
        else:
            out.append(np.zeros(0, "u8"))
        start = end
    return out
