"""Hashes of words and of runs of words, by numpy over whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Words whose hash a worker remembers; it forgets all beyond that.
REMEMBERED = 1_000_000
#: Odd, so that each has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
SECOND_BASE = 0xD1B54A32D192ED03


class _Codes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = code = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return code


_codes = _Codes()


def codes(words: list[str]) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.fromiter(map(_codes.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n-1) modulo 2**64."""
    kept = _kept.get(base)
    if kept is None or len(kept) < n:
        kept = np.full(max(n + n // 4, 4096), base, np.uint64)
        kept[0] = 1
        kept = np.multiply.accumulate(kept)
        _kept[base] = kept if len(kept) <= 1 << 22 else _kept.get(base, kept[: 1 << 20])
    return kept[:n]


_kept: dict[int, np.ndarray] = {}


def run_hashes(words: np.ndarray, size: int, base: int = BASE) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` words, one per start."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    if size <= 4:
        out = np.zeros(n, np.uint64)
        for k in range(size):
            out = (out + words[k : k + n]) * np.uint64(base)
            out ^= out >> np.uint64(29)
        return mixed(out)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(base, len(words)), dtype=np.uint64)])
    inverse = pow(base, -1, 1 << 64)
    return mixed((sums[size:] - sums[:n]) * _powers(inverse, n))


#: Bytes of text whose n-grams are made at once; a longer text is one such piece by itself.
BYTES_AT_ONCE = 1_000_000
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_LETTER = mixed(np.arange(1, 257, dtype=np.uint64))


def _spaces(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text are white space, as ``str.split`` sees it."""
    space = _SPACE[data]
    if data.max(initial=0) < 0xC2:
        return space
    for lead, rest in ((0xC2, ((0x85,), (0xA0,))), (0xE1, ((0x9A, 0x80),)), (0xE2, (*((0x80, x) for x in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), (0x81, 0x9F))), (0xE3, ((0x80, 0x80),))):
        at = np.flatnonzero(data == lead)
        for tail in rest if len(at) else ():
            fits = at[at + len(tail) < len(data)]
            for k, byte in enumerate(tail, 1):
                fits = fits[data[fits + k] == byte]
            for k in range(len(tail) + 1):
                space[fits + k] = True
    return space


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, bytes, text) of every word of the texts that lie between ``offsets``."""
    solid = ~_spaces(data)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], solid[:-1]]) & ~edge[:-1]
    after = np.concatenate([solid[1:], [False]]) & ~edge[1:]
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTER[data] * _powers(BASE, len(data)), dtype=np.uint64)])
    hashes = (sums[ends] - sums[starts]) * _powers(pow(BASE, -1, 1 << 64), len(data))[starts]
    return mixed(hashes + (ends - starts).astype(np.uint64)), ends - starts, np.searchsorted(offsets, starts, side="right") - 1


def gram_sets(texts: pa.Array, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, key) of the distinct word n-grams of each text, pieces of the batch at a time, sorted by both.

    Words are lower-case. A key has the bytes of the n-gram's words in its upper 8 bits, most first, and 56 bits of hash
    below. A text of fewer words than n is one n-gram, a text without words has none.
    """
    lowered = pc.utf8_lower(texts.cast(pa.large_string()))
    offsets = np.frombuffer(lowered.buffers()[1], np.int64)[lowered.offset : lowered.offset + len(lowered) + 1]
    whole = np.frombuffer(lowered.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(lowered):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BYTES_AT_ONCE, side="right")) - 1)
        data, own = whole[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        base, first = first, last
        if not len(data):
            continue
        hashes, sizes, text = _words(data, own)
        bounds = np.searchsorted(text, np.arange(len(own)))
        count = np.diff(bounds)
        keys, owners = [], []
        for size in range(1, n + 1):
            # Shorter n-grams are only made of texts that have no more words.
            run = np.arange(max(0, len(hashes) - size + 1))
            run = run[(text[run] == text[run + size - 1]) & ((count[text[run]] == size) if size < n else (count[text[run]] >= n))]
            mix, length = np.zeros(len(run), np.uint64), np.zeros(len(run), np.int64)
            for k in range(size):
                mix = (mix + hashes[run + k]) * np.uint64(BASE)
                mix ^= mix >> np.uint64(29)
                length += sizes[run + k]
            keys.append((np.uint64(255) - np.minimum(length, 255).astype(np.uint64)) << np.uint64(56) | mixed(mix) >> np.uint64(8))
            owners.append(text[run])
        key, owner = np.concatenate(keys), np.concatenate(owners)
        order = np.lexsort((key, owner))
        key, owner = key[order], owner[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
        yield owner[new] + base, key[new]
