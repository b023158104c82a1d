"""Word shingles as 64-bit hashes, worked out in numpy over whole Arrow batches.

Texts have A-Z lower-cased and are cut into words ``[^\\x20\\x09-\\x0D]+``. A
word's hash is a polynomial over its bytes, taken from prefix sums modulo 2^64
and then mixed; a shingle's hash folds the hashes of its words. The bytes are
worked through in windows of bounded size that end between words, so memory
follows the number of words of one slice of documents and not its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Odd multipliers of the polynomial and of the mixing steps (fixed values).
BASE = 0x9E3779B97F4A7C15
FOLD = 0xD1342543DE82EF95
MIX_A = 0xBF58476D1CE4E5B9
MIX_B = 0x94D049BB133111EB
SEPARATORS = bytes([0x20, *range(0x09, 0x0E)])
WINDOW = 1 << 18
SLICE = 1 << 19

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_is_sep = np.zeros(256, dtype=bool)
_is_sep[list(SEPARATORS)] = True
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(MIX_A)
    x = (x ^ (x >> U(27))) * U(MIX_B)
    return x ^ (x >> U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        inverse = pow(BASE, -1, 1 << 64)
        for name, base in (("up", BASE), ("down", inverse)):
            steps = np.full(max(n, 2 * WINDOW), base, dtype=U)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, document)`` of each word of the documents ``data[offsets[i]:offsets[i + 1]]``."""
    hashes, owners, at, end = [], [], int(offsets[0]), int(offsets[-1])
    while at < end:
        to = min(at + WINDOW, end)
        while to < end and not _is_sep[data[to]]:
            ahead = np.flatnonzero(_is_sep[data[to : to + WINDOW]])
            to = to + int(ahead[0]) if len(ahead) else min(to + WINDOW, end)
        part = _lower[data[at:to]]
        sep = _is_sep[part]
        first = ~sep
        first[1:] &= sep[:-1]
        last = ~sep
        last[:-1] &= sep[1:]
        cuts = offsets[(offsets > at) & (offsets < to)] - at
        first[cuts] = ~sep[cuts]
        last[cuts - 1] = ~sep[cuts - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = _power_tables(len(part) + 1)
        sums = np.zeros(len(part) + 1, dtype=U)
        np.cumsum((part.astype(U) + U(1)) * up[: len(part)], out=sums[1:])
        hashes.append(mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U)))
        owners.append(np.searchsorted(offsets, starts + at, side="right") - 1)
        at = to
    if not hashes:
        return np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes (int64); none without words.

    A text of fewer than ``words`` words has its whole sequence as one shingle.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE, side="right")) - 1)
        hashes, owner = word_hashes(data, offsets[lo : hi + 1])
        counts = np.bincount(owner, minlength=hi - lo)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        folded = hashes[: max(0, len(hashes) - words + 1)].copy()
        for k in range(1, words):
            folded = folded * U(FOLD) + hashes[k : k + len(folded)]
        folded = mix(folded + U(words))
        for i in range(hi - lo):
            a, n = int(bounds[i]), int(counts[i])
            if n >= words:
                yield np.unique(folded[a : a + n - words + 1].view(np.int64))
            elif n:
                whole = hashes[a : a + 1].copy()
                for k in range(1, n):
                    whole = whole * U(FOLD) + hashes[a + k]
                yield mix(whole + U(n)).view(np.int64)
            else:
                yield np.zeros(0, dtype=np.int64)
        lo = hi


def set_keys(own: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share: a sum and an exclusive or of mixed members."""
    u = own.view(U)
    return int(mix(u ^ U(FOLD)).sum(dtype=U).astype(np.int64)), int(np.bitwise_xor.reduce(mix(u + U(BASE))).astype(np.int64))
