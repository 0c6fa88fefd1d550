"""Jaccard self-join of documents on word n-grams: a blocked sparse matrix product with size-derived bounds.

The incidence matrix has a row for each distinct set of n-grams (documents of one set are a class, so copies never
meet each other) and a column for each n-gram. For Jaccard similarity t two sets of a and b n-grams overlap in at
least t (a + b) / (1 + t), which bounds everything that follows:

1. In one order of all n-grams, two such sets share one among the first ``size - ceil(t size) + 1`` of the larger and the first
   ``size - ceil(2 t / (1 + t) size) + 1`` of the smaller, so only those entries of the matrix are multiplied. The order puts n-grams of more characters first, for they are rarer, and
   those that proved frequent last; any order is right, a good one has short columns.
2. Columns are spread by hash and sorted. A column that very many sets share is cut into blocks of sets, and each pair of blocks is
   a column by itself, so its square is spread too. Each task multiplies its columns by size, shortest sets first, passes over
   pairs whose sizes alone rule them out, and adds up the overlap of each pair.
3. A pair whose overlap so far and the rest of either row together stay below its bound is discarded. The
   others are counted in full from their whole sets, and those that reach t stay.

Large groups of near copies are all pairs by nature, so they go another way. In each of ``ROUNDS`` rounds the least of a set's n-grams by
two hashes name a cell; two sets of similarity s share it with chance s * s. Cells of ``CELL_LEAST`` sets and more are cut into blocks, and
one task counts the pairs of two blocks from their whole sets, as matrices; it returns the links of each set and what joins
them, no pairs. The product above passes over pairs that share such a cell, and a later round over those of the rounds before, so each
pair is counted once, wherever it is met. Smaller cells, and any beyond ``MAX_CELLS``, are left to the product.

A set is known by 64 bits of a hash of 128; that these bits tell all sets apart is checked over all classes, and sets that
share them go by the other 64. What is broadcast is bounded: at most ``MAX_FREQUENT`` hashes, the most
frequent ones, and the rows of candidates only up to ``BROADCAST_ROWS``; beyond that the same join shuffles.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint, drop_unused, fresh, shuffle_partitions, with_row_id
from tessera.llm.grams import gram_sets, mixed

N = 3
THRESHOLD = 0.6
#: Sets that must have an n-gram among their first ones for it to move to the end of the order.
FREQUENT = 64
MAX_FREQUENT = 2_000_000
#: Share beyond the first n-grams that is counted too, as others move up where frequent ones move down.
MARGIN = 1.25
BROADCAST_ROWS = 500_000
#: Documents that share a frequent n-gram for each block of its column.
BLOCK = 4_096
#: N-grams of the left sets that one task holds to count pairs in full.
GRAMS_AT_ONCE = 1_500_000
#: Hashes by which sets fall into cells, distinct sets that make a cell worth a product of its own, and such cells at most.
ROUNDS = 3
CELL_LEAST = 64
MAX_CELLS = 60_000
#: N-grams, and sets, in a block of a cell.
CELL_GRAMS = 1_000_000
CELL_SETS = 2_000
#: Sets of a block that are multiplied at once, and columns of a dense slice.
ROWS_AT_ONCE = 256
SLICE = 2_048
#: Bits of a round's cell in the cells of a set.
CELL_BITS = 20
KEYS_AT_ONCE = 1_000_000
ENTRIES_AT_ONCE = 400_000
PAIRS_AT_ONCE = 500_000
PARTNERS_AT_ONCE = 256
SETS_AT_ONCE = 500
#: Bits of an n-gram's hash within its task, and sets in a row of entries.
KEY_BITS = 30
MOST_OWNERS = 1 << 15


def gram_set(text: str, n: int = N) -> np.ndarray:
    """The distinct n-grams of one text, in the order of the join."""
    return np.concatenate([np.empty(0, np.uint64), *(keys for _, keys in gram_sets(pa.array([text]), n))])


def identity(keys: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set, 64 bits each."""
    digest = xxhash.xxh3_128_intdigest(keys.tobytes())
    return (digest >> 64) - (1 << 63), (digest & (1 << 64) - 1) - (1 << 63)


def _names(keys: np.ndarray, starts: np.ndarray, sizes: np.ndarray, shared: frozenset[int]) -> tuple[np.ndarray, np.ndarray]:
    """(name, other hash) of each set; a set whose first hash is ``shared`` with another goes by the second."""
    both = [identity(keys[a : a + m]) for a, m in zip(starts, sizes)]
    return np.array([y if x in shared else x for x, y in both], np.int64), np.array([y for _, y in both], np.int64)


def _leasts(keys: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Of each round, the least hashes of the n-grams of each set by two orders, as one."""
    seeds = mixed(np.arange(1, 2 * ROUNDS + 1, dtype=np.uint64))
    least = [np.minimum.reduceat(mixed(keys ^ seed), starts) if len(starts) else np.empty(0, np.uint64) for seed in seeds]
    return [mixed(x + mixed(y)) for x, y in zip(least[::2], least[1::2])]


def _cells(keys: np.ndarray, starts: np.ndarray, known: list[np.ndarray]) -> np.ndarray:
    """The large cells of each set: ``CELL_BITS`` for each round, 0 where it is in none of them."""
    out = np.zeros(len(starts), np.int64)
    if any(map(len, known)):
        for r, (own, least) in enumerate(zip(known, _leasts(keys, starts))):
            if len(own):
                at = np.minimum(np.searchsorted(own, least), len(own) - 1)
                out |= np.where(own[at] == least, at + 1, 0) << CELL_BITS * r
    return out


def _apart(a: np.ndarray, b: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Whether sets of cells ``a`` and ``b`` share no large cell in the first rounds."""
    out = np.ones(np.broadcast_shapes(a.shape, b.shape), bool)
    for r in range(rounds):
        own, other = (x >> CELL_BITS * r & (1 << CELL_BITS) - 1 for x in (a, b))
        out &= (own != other) | (own == 0)
    return out


def _least(threshold: float, sizes: np.ndarray) -> np.ndarray:
    """Overlap that sets of these sizes need at least with any partner."""
    return np.ceil(threshold * sizes - 1e-9).astype(np.int64)


def _least_of_smaller(threshold: float, sizes: np.ndarray) -> np.ndarray:
    """Overlap that sets of these sizes need at least with a partner that isn't smaller."""
    return np.ceil(2 * threshold / (1 + threshold) * sizes - 1e-9).astype(np.int64)


def _rows_of(texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(texts that have n-grams, their starts, their sizes, the place of each n-gram in its set) of sorted owners."""
    starts = np.flatnonzero(np.concatenate([[True], texts[1:] != texts[:-1]])) if len(texts) else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, len(texts)))
    return texts[starts], starts, sizes, np.arange(len(texts)) - np.repeat(starts, sizes)


def _counted(threshold: float, n: int):  # noqa: ANN202
    """(hash, count) of the first n-grams of sets, added up over ``KEYS_AT_ONCE`` at a time; 32 bits of hash, as the frequent ones only set an order."""

    def report(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate([np.empty(0, np.uint32), *held]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int32)), pa.array(counts.astype(np.int32))], names=["hash", "count"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for texts, keys in gram_sets(batch.column(0), n):
                _, _, sizes, place = _rows_of(texts)
                most = np.ceil(MARGIN * (sizes - _least(threshold, sizes) + 1))
                held.append(keys[place < np.repeat(most, sizes)].astype(np.uint32))
                if sum(map(len, held)) >= KEYS_AT_ONCE:
                    yield report(held)
                    held = []
        yield report(held)

    return run


def in_blocks(keys: np.ndarray, sets: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, key, side) of entries whose columns are cut into ``groups`` blocks: one for each pair of blocks an entry is part of.

    Side 0 meets all of its column, 1 and 2 meet only each other.
    """
    entry = np.repeat(np.arange(len(keys)), groups)
    other = np.arange(len(entry)) - np.repeat(np.cumsum(groups) - groups, groups)
    own = (sets.view(np.uint64) % groups.astype(np.uint64)).astype(np.int64)[entry]
    pair = np.minimum(own, other) << 32 | np.maximum(own, other)
    key = np.where(groups[entry] > 1, mixed(keys[entry] ^ mixed(pair.astype(np.uint64) + np.uint64(1))), keys[entry])
    return entry, key, np.where(own == other, 0, np.where(own < other, 1, 2))


def _unlike(keys: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """Sorted ``keys`` of sorted owners, in which a key that its owner has already is moved up to the next one free.

    Two owners then have as many keys in common as before at least: what they share takes the same places whatever else they have.
    """
    place = np.arange(len(keys))
    apart = owners.astype(np.int64) << 32
    return np.maximum.accumulate(apart + keys - place) + place - apart


def _entries(threshold: float, n: int, frequent: Broadcast, shared: frozenset[int], parts: int, bits: int = KEY_BITS):  # noqa: ANN202
    """(part, hashes, owners, marks, sets, cells) of the first n-grams of some sets, frequent ones last, by the task that multiplies them.

    An owner is the place of its set in the other lists, so that a set is named once. A mark is 4 times the set's size and a side. The
    last bit of a hash says whether the n-gram is among the first ones of a smaller set. Within a task a hash has few bits: n-grams that
    share them only add candidates, which are counted in full later.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, blocks, large = frequent.value
        for batch in batches:
            for texts, keys in gram_sets(batch.column(0), n):
                owners, starts, sizes, place = _rows_of(texts)
                sets, _ = _names(keys, starts, sizes, shared)
                cells = _cells(keys, starts, large)
                groups = np.ones(len(keys), np.int64)
                if len(often):
                    low = keys.astype(np.uint32)
                    at = np.minimum(np.searchsorted(often, low), len(often) - 1)
                    known = often[at] == low
                    groups[known] = blocks[at[known]]
                    order = np.lexsort((known, texts))
                    keys, groups = keys[order], groups[order]
                chosen = place < np.repeat(sizes - _least(threshold, sizes) + 1, sizes)
                which = np.repeat(np.arange(len(owners)), sizes)[chosen]
                smaller = (place < np.repeat(sizes - _least_of_smaller(threshold, sizes) + 1, sizes))[chosen]
                entry, key, side = in_blocks(keys[chosen], sets[which], groups[chosen])
                key = mixed(key)
                part = (key % np.uint64(parts)).astype(np.int64)
                key = (key >> np.uint64(64 - bits)).astype(np.int64)
                lists = (part * len(owners) + which[entry]) * 3 + side
                order = np.lexsort((key, lists))
                key, lists, smaller = key[order], lists[order], smaller[entry][order]
                starts = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1]])) if len(key) else np.empty(0, np.int64)
                number = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(key))))
                free = _unlike(key, number)
                if len(moved := np.unique(number[free != key])):
                    smaller |= np.isin(number, moved)
                lists = lists[starts]
                part, own, side = lists // (3 * len(owners)), lists // 3 % len(owners), lists % 3
                place = _rows_of(part)[3]
                firsts = np.flatnonzero(place % MOST_OWNERS == 0)
                ends = np.append(firsts, len(lists))
                hashes = (free << 1 | smaller).astype(np.uint32).view(np.int32)
                held = (number - firsts[np.searchsorted(firsts, number, side="right") - 1]).astype(np.int16)
                by_entry, by_list = (pa.array(x.astype(np.int32)) for x in (np.append(starts, len(key))[ends], ends))
                columns = [pa.array(part[firsts].astype(np.int32)), *(pa.ListArray.from_arrays(by_entry, pa.array(x)) for x in (hashes, held))]
                columns += [pa.ListArray.from_arrays(by_list, pa.array(x)) for x in ((sizes[own] * 4 + side).astype(np.int32), sets[own], cells[own])]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "hashes", "owners", "marks", "sets", "cells"])

    return run


def _sums(a: np.ndarray, b: np.ndarray, counts: np.ndarray, *more: np.ndarray) -> list[np.ndarray]:
    """Distinct pairs, what else comes with them, and their counts added up."""
    order = np.lexsort((b, a))
    a, b, counts = a[order], b[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.empty(0, np.int64)
    added = np.add.reduceat(counts, starts) if len(a) else counts
    return [a[starts], b[starts], added, *(m[order][starts] for m in more)]


def multiply(hashes: np.ndarray, marks: np.ndarray, sets: np.ndarray, smaller: np.ndarray, threshold: float, cells: np.ndarray | None = None) -> Iterator[list[np.ndarray]]:
    """Products of whole columns, entries sorted by (hash, mark, set): (a, b, overlap, size of a, size of b), copies once.

    ``smaller`` says which entries count as the smaller set's; pairs that share one of their ``cells`` are passed over.
    """
    keep = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (marks[1:] != marks[:-1]) | (sets[1:] != sets[:-1])]) if len(hashes) else np.empty(0, bool)
    hashes, sets, sizes, sides, smaller = hashes[keep], sets[keep], marks[keep] >> 2, marks[keep] & 3, smaller[keep].astype(bool)
    cells = cells[keep] if cells is not None and cells.any() else None
    held: list[np.ndarray] = []
    count, apart = 0, 1

    def added() -> list[np.ndarray]:
        i, j = np.concatenate(held, axis=1)
        swap = sets[i] > sets[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        return _sums(sets[i], sets[j], np.ones(len(i), np.int64), sizes[i], sizes[j])

    left = np.arange(len(hashes))
    while True:
        left = left[left + apart < len(hashes)]
        # Sizes grow within a column, so a set that is too short for one is too short for all after it.
        left = left[(hashes[left] == hashes[left + apart]) & (sizes[left] >= threshold * sizes[left + apart] - 1e-9)]
        if not len(left):
            break
        meet = left[smaller[left] & ((sides[left] == 0) | (sides[left] != sides[left + apart]))]
        if cells is not None:
            meet = meet[_apart(cells[meet], cells[meet + apart])]
        held.append(np.stack([meet, meet + apart]))
        count += len(meet)
        if count >= PAIRS_AT_ONCE:
            yield added()
            held, count = [], 0
        apart += 1
    if count:
        yield added()


def _planes(*columns: np.ndarray) -> bytes:
    """Longs by significance of their bytes, which compresses well; the first column by its differences."""
    planes = np.stack(columns).astype("<i8")
    planes[0, 1:] = np.diff(planes[0])
    return np.ascontiguousarray(planes.view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1)).tobytes()


def _columns(data: bytes, columns: int, size: int) -> list[np.ndarray]:
    raw = np.frombuffer(data, np.uint8).reshape(columns, 8, size)
    planes = np.ascontiguousarray(raw.transpose(0, 2, 1)).view("<i8").reshape(columns, size)
    return [np.cumsum(planes[0]), *planes[1:]]


def pack(a: np.ndarray, b: np.ndarray, overlap: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> bytes:
    """Pairs sorted by (a, b) as bytes: each set once with its size, then pairs of places in that list."""
    sets, first = np.unique(np.concatenate([a, b]), return_index=True)
    sizes = np.concatenate([size_a, size_b])[first]
    data = _planes(sets, sizes) + _planes(np.searchsorted(sets, a), np.searchsorted(sets, b), overlap)
    return struct.pack("<II", len(sets), len(a)) + zstandard.ZstdCompressor(level=1).compress(data)


def unpack(data: bytes) -> list[np.ndarray]:
    m, size = struct.unpack_from("<II", data)
    raw = zstandard.ZstdDecompressor().decompress(data[8:])
    sets, sizes = _columns(raw[: 16 * m], 2, m)
    i, j, overlap = _columns(raw[16 * m :], 3, size)
    return [sets[i], sets[j], overlap, sizes[i], sizes[j]]


def _product(threshold: float, buckets: int):  # noqa: ANN202
    """(bucket, pairs): partial sums of a block of columns, by buckets of their left rows."""

    def out(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for found in multiply(*columns[:4], threshold, columns[4]):
            bucket = (mixed(found[0].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            starts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(starts))
            packed = [pack(*(f[order[starts[k] : starts[k + 1]]] for f in found)) for k in full]
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(packed, pa.binary())], names=["bucket", "pairs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[np.empty(0, np.int64)] * 5]
        for batch in batches:
            hashes, marks, sets, cells = (c.to_numpy() for c in batch.columns)
            held.append([hashes >> 1, marks, sets, hashes & 1, cells])
            if sum(len(h[0]) for h in held) < ENTRIES_AT_ONCE:
                continue
            whole = [np.concatenate(c) for c in zip(*held)]
            cut = int(np.searchsorted(whole[0], whole[0][-1]))
            yield from out([w[:cut] for w in whole])
            held = [[w[cut:].copy() for w in whole]]
        yield from out([np.concatenate(c) for c in zip(*held)])

    return run


def _candidates(threshold: float):  # noqa: ANN202
    """(a, b, size_a, size_b) of the pairs that can still reach the threshold, from all partial sums of their bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[list[np.ndarray]]] = {}
        for batch in batches:
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = parts.setdefault(bucket, [])
                own.append(unpack(data.as_py()))
                if len(own) > 16:
                    parts[bucket] = [_sums(*map(np.concatenate, zip(*own)))]
        for own in parts.values():
            a, b, overlap, size_a, size_b = _sums(*map(np.concatenate, zip(*own)))
            # Beyond the first n-grams of the set whose first ones end sooner, it has at most its least overlap less one left.
            rest = np.maximum(_least(threshold, np.maximum(size_a, size_b)), _least_of_smaller(threshold, np.minimum(size_a, size_b))) - 1
            fits = overlap + rest >= np.ceil(threshold / (1 + threshold) * (size_a + size_b) - 1e-9)
            yield pa.RecordBatch.from_arrays([pa.array(x[fits]) for x in (a, b, size_a, size_b)], names=["a", "b", "size_a", "size_b"])

    return run


def _classes(n: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts, keys in gram_sets(batch.column(0), n):
                owners, starts, sizes, _ = _rows_of(texts)
                first, second = _names(keys, starts, sizes, frozenset())
                at = pa.array(owners)
                columns = [batch.column(1).take(at), batch.column(2).take(at), pa.array(first), pa.array(second), pa.array(sizes)]
                columns += [pa.array(x.view(np.int64)) for x in _leasts(keys, starts)]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "set", "other", "size", *(f"least{r}" for r in range(ROUNDS))])

    return run


def _sets(n: int, *more: str):  # noqa: ANN202
    """(to_task, set, more, grams) of rows (text, tasks, set, more): the set's n-grams once for each task that needs them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts, keys in gram_sets(batch.column(0), n):
                owners, starts, sizes, _ = _rows_of(texts)
                at = pa.array(owners)
                tasks = batch.column(1).take(at)
                again = np.repeat(np.arange(len(owners)), tasks.value_lengths().to_numpy())
                for k in range(0, max(1, len(again)), SETS_AT_ONCE):
                    own = pa.array(again[k : k + SETS_AT_ONCE])
                    grams = pa.array([keys[starts[i] : starts[i] + sizes[i]].tobytes() for i in own.to_numpy()], pa.binary())
                    others = [batch.column(2 + c).take(at).take(own) for c in range(1 + len(more))]
                    yield pa.RecordBatch.from_arrays([tasks.flatten().slice(k, len(own)), *others, grams], names=["to_task", "set", *more, "grams"])

    return run


def _held(rows: np.ndarray, columns: np.ndarray, height: int, first: int, last: int) -> np.ndarray:
    """The columns from ``first`` to ``last`` of a sparse 0-1 matrix, written out."""
    out = np.zeros((height, last - first), np.float32)
    fits = (columns >= first) & (columns < last)
    out[rows[fits], columns[fits] - first] = 1
    return out


def overlaps_of(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each set on the left shares with each on the right."""
    out = np.zeros((len(left), len(right)), np.int64)
    rows, others = (np.repeat(np.arange(len(x)), [*map(len, x)]) for x in (left, right))
    keys, columns = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    mine, theirs = columns[: len(rows)], columns[len(rows) :]
    held, met = np.bincount(mine, minlength=len(keys)), np.bincount(theirs, minlength=len(keys))
    # Columns that few sets share are multiplied entry by entry, the others as dense slices.
    dense = held * met > len(left) * len(right) // 200 + 1
    place = np.cumsum(dense) - 1
    on, at = dense[mine], dense[theirs]
    for k in range(0, int(dense.sum()), SLICE):
        last = min(k + SLICE, int(dense.sum()))
        out += (_held(rows[on], place[mine[on]], len(left), k, last) @ _held(others[at], place[theirs[at]], len(right), k, last).T).astype(np.int64)
    order = np.argsort(theirs, kind="stable")
    starts = np.concatenate([[0], np.cumsum(met)])
    light = np.flatnonzero(~on & (met[mine] > 0))
    count = met[mine[light]]
    flat = out.reshape(-1)
    ends = np.cumsum(count)
    first = 0
    while first < len(light):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + PAIRS_AT_ONCE, side="right")))
        part, n = light[first:last], count[first:last]
        with_ = order[np.repeat(starts[mine[part]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        flat += np.bincount(np.repeat(rows[part], n) * len(right) + others[with_], minlength=len(flat)) if len(with_) * 4 > len(flat) else 0
        if len(with_) * 4 <= len(flat):
            np.add.at(flat, np.repeat(rows[part], n) * len(right) + others[with_], 1)
        first = last
    return out


def _joined(linked: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each row and column of a matrix of links, the number of the group it is connected to (``same``: rows are the columns)."""
    rows, columns = np.full(linked.shape[0], -1), np.full(linked.shape[1], -1)
    for group, start in enumerate(np.flatnonzero(linked.any(axis=1))):
        if rows[start] >= 0:
            continue
        new = np.array([start])
        while len(new):
            rows[new] = group
            reached = np.flatnonzero(linked[new].any(axis=0) & (columns < 0))
            columns[reached] = group
            found = linked[:, reached].any(axis=1)
            if same:
                found[reached] = True
            new = np.flatnonzero(found & (rows < 0))
    return rows, columns


def _cell_links(threshold: float):  # noqa: ANN202
    """(set, links, near) from the sets of two blocks of a cell, or of one: the documents that each is linked with there, and a set that it is connected to."""

    def run(key: tuple, sets: pd.DataFrame) -> pd.DataFrame:
        sets = sets.sort_values("set", ignore_index=True)
        rounds = int(sets["to_task"].iloc[0] >> 1) % 4
        side = sets["to_task"].to_numpy() & 1
        sides = [np.flatnonzero(side == k) for k in (0, 1)]
        same = not len(sides[1])
        if same:
            sides[1] = sides[0]
        names, held, cells = (sets[c].to_numpy() for c in ("set", "held", "cells"))
        grams = [np.frombuffer(g, np.uint64) for g in sets["grams"]]
        sizes = np.array([*map(len, grams)])
        left, right = sides
        linked = np.zeros((len(left), len(right)), bool)
        for k in range(0, len(left), ROWS_AT_ONCE):
            some = left[k : k + ROWS_AT_ONCE]
            overlap = overlaps_of([grams[i] for i in some], [grams[i] for i in right])
            fits = overlap >= threshold * (sizes[some][:, None] + sizes[right][None] - overlap) - 1e-9
            linked[k : k + len(some)] = fits & _apart(cells[some][:, None], cells[right][None], rounds)
        if same:
            np.fill_diagonal(linked, False)
        groups = _joined(linked, same)
        ends = [(names[left], linked @ held[right], groups[0])] + ([] if same else [(names[right], held[left] @ linked, groups[1])])
        out = pd.DataFrame({c: np.concatenate(x) for c, x in zip(("set", "links", "near"), zip(*ends))})
        out = out[out["near"] >= 0]
        return out.assign(near=out.groupby("near")["set"].transform("min"))

    return run


def _overlaps(key: tuple, pairs: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
    """Full overlaps: each left set is looked up in by all its partners' n-grams at once."""
    whole = {s: np.frombuffer(g, np.uint64) for s, g in zip(sets["set"], sets["grams"])}
    pairs = pairs.sort_values(["a", "b"], ignore_index=True)
    overlap = np.zeros(len(pairs), np.int64)
    left, right = pairs["a"].to_numpy(), pairs["b"].to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1]])) if len(left) else np.empty(0, np.int64)
    for i, j in zip(starts, np.append(starts[1:], len(left))):
        own = whole[left[i]]
        for k in range(i, j, PARTNERS_AT_ONCE):
            others = [whole[b] for b in right[k : min(j, k + PARTNERS_AT_ONCE)]]
            joined = np.concatenate(others)
            found = own[np.minimum(np.searchsorted(own, joined), len(own) - 1)] == joined
            bounds = np.cumsum([0, *map(len, others[:-1])])
            overlap[k : k + len(others)] = np.add.reduceat(found, bounds, dtype=np.int64)
    return pairs[["a", "b", "size_a", "size_b"]].assign(overlap=overlap)


def _frequent(counts: DataFrame, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, blocks of each one's column) of the highest counts, at most ``bound`` of them.

    The cut comes from a histogram of the counts, so the driver gets the chosen rows only. What is left out only
    stays where it is in the order of the join. ``counts`` is read twice and should be a checkpoint.
    """
    held, least = 0, 0
    for value, rows in counts.groupBy("count").agg(F.count("*").alias("rows")).orderBy(F.desc("count")).select("count", "rows").toLocalIterator():
        if held + rows > bound:
            break
        held, least = held + rows, value
    if not held:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    chosen = counts.where(F.col("count") >= least).toPandas()
    hashes = chosen["hash"].to_numpy(np.int32).view(np.uint32)
    order = np.argsort(hashes)
    return hashes[order], -(-chosen["count"].to_numpy(np.int64)[order] // BLOCK)


def _with(df: DataFrame, keys: DataFrame, on: str, count: int) -> DataFrame:
    """``df`` joined with ``count`` rows of ``keys``: broadcast up to a size, else shuffled."""
    return df.join(F.broadcast(keys) if count <= BROADCAST_ROWS else keys.hint("merge"), on)


def _large_cells(members: DataFrame) -> list[np.ndarray]:
    """Of each round, the sorted hashes of the cells of ``CELL_LEAST`` sets or more, the largest where there are more than ``MAX_CELLS``."""
    sights = members.select(F.posexplode(F.array(*(f"least{r}" for r in range(ROUNDS)))).alias("round", "least"))
    large = sights.groupBy("round", "least").agg(F.count("*").alias("sets")).where(F.col("sets") >= CELL_LEAST).orderBy(F.desc("sets"), "round", "least").limit(MAX_CELLS).collect()
    return [np.sort(np.array([x["least"] for x in large if x["round"] == r], np.int64).view(np.uint64)) for r in range(ROUNDS)]


def _within_cells(rows: DataFrame, members: DataFrame, large: list[np.ndarray], threshold: float, n: int) -> DataFrame:
    """(set, links, near) of the pairs that share one of the ``large`` cells; rows of a set are to be added up."""
    spark = rows.sparkSession
    held = members
    for r, own in enumerate(large):
        known = spark.createDataFrame([(int(x), k + 1) for k, x in enumerate(own.view(np.int64))], f"least{r} long, cell{r} long")
        held = held.join(F.broadcast(known), f"least{r}", "left")
    cell = [F.coalesce(F.col(f"cell{r}"), F.lit(0)) for r in range(ROUNDS)]
    packed = sum((F.shiftleft(c, CELL_BITS * r) for r, c in enumerate(cell)), F.lit(0).cast("long"))
    held = checkpoint(held.select("set", "row", "held", "size", packed.alias("cells")).where("cells > 0"))
    at = lambda c, r: F.shiftright(c, CELL_BITS * r).bitwiseAND(F.lit((1 << CELL_BITS) - 1))
    entries = held.withColumn("round", F.explode(F.array(*map(F.lit, range(ROUNDS)))))
    # Sets of one earlier cell lie side by side, so that most blocks of them needn't meet again.
    earlier = [F.when(F.col("round") > r, at(F.col("cells"), r)).otherwise(0).alias(f"before{r}") for r in range(ROUNDS - 1)]
    entries = entries.select("*", F.expr(" ".join(["CASE round", *(f"WHEN {r} THEN shiftright(cells, {CELL_BITS * r}) & {(1 << CELL_BITS) - 1}" for r in range(ROUNDS)), "END"])).alias("cell"), *earlier).where("cell > 0")
    own = Window.partitionBy("round", "cell").orderBy(*(f"before{r}" for r in range(ROUNDS - 1)), "size", "set").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    weight = F.col("size") + -(-CELL_GRAMS // CELL_SETS)
    entries = checkpoint(entries.withColumn("block", F.floor(F.sum(weight).over(own) / CELL_GRAMS)))
    ends = [f(c).alias(f"{name}_{c}") for c in ("size", *(f"before{r}" for r in range(ROUNDS - 1))) for name, f in (("low", F.min), ("high", F.max))]
    blocks = checkpoint(entries.groupBy("round", "cell", "block").agg(F.count("*").alias("sets"), *ends))
    x, y = blocks.alias("x"), blocks.alias("y")
    apart = F.col("x.block") <= F.col("y.block")
    for r in range(ROUNDS - 1):
        c = f"before{r}"
        alike = (F.col(f"x.low_{c}") == F.col(f"x.high_{c}")) & (F.col(f"y.low_{c}") == F.col(f"y.high_{c}")) & (F.col(f"x.low_{c}") == F.col(f"y.low_{c}")) & (F.col(f"x.low_{c}") > 0)
        apart &= ~alike
    fits = (F.col("x.high_size") >= threshold * F.col("y.low_size") - 1e-9) & (F.col("y.high_size") >= threshold * F.col("x.low_size") - 1e-9)
    met = x.join(y, (F.col("x.round") == F.col("y.round")) & (F.col("x.cell") == F.col("y.cell")) & apart & fits)
    met = met.where("x.block < y.block OR x.sets > 1").select("x.round", "x.cell", F.col("x.block").alias("i"), F.col("y.block").alias("j"))
    met = checkpoint(met.withColumn("task", F.monotonically_increasing_id() * 8 + F.col("round") * 2))
    needed = met.select("round", "cell", F.col("i").alias("block"), "task").unionAll(met.where("i < j").select("round", "cell", "j", F.col("task") + 1))
    placed = entries.join(needed, ["round", "cell", "block"]).groupBy("set").agg(F.min("row").alias("row"), F.first("held").alias("held"), F.first("cells").alias("cells"), F.collect_list("task").alias("tasks"))
    shipped = _with(rows.select("text", "row"), placed, "row", held.count()).select("text", "tasks", "set", "held", "cells").mapInArrow(_sets(n, "held", "cells"), "to_task long, set long, held long, cells long, grams binary")
    return checkpoint(shipped.groupBy(F.shiftright("to_task", 1).alias("task")).applyInPandas(_cell_links(threshold), "set long, links long, near long"))


def similar_sets(rows: DataFrame, threshold: float = THRESHOLD, n: int = N) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Of rows (row, id, text): their classes (row, id, set), the sets (set, row, held, size), the links (set, links) with documents of other sets, and pairs (a, b) that connect what is linked."""
    spark = rows.sparkSession
    parts = shuffle_partitions(spark)
    rows = rows.where(F.col("text").isNotNull())
    texts = rows.select("text")
    kinds = [rows.schema[c].dataType.simpleString() for c in ("row", "id")]
    leasts = [f"least{r}" for r in range(ROUNDS)]
    signed = rows.select("text", "row", "id").mapInArrow(_classes(n), f"row {kinds[0]}, id {kinds[1]}, set long, other long, size long, {', '.join(f'{c} long' for c in leasts)}")
    classes = checkpoint(signed)
    clash = classes.groupBy("set").agg(F.min("other").alias("low"), F.max("other").alias("high")).where("low <> high")
    shared = frozenset(r["set"] for r in clash.toLocalIterator())
    name = F.when(F.col("set").isin(*shared), F.col("other")).otherwise(F.col("set")) if shared else F.col("set")
    classes = classes.select("row", "id", name.alias("set"), "size", *leasts)
    members = checkpoint(classes.groupBy("set").agg(F.min("row").alias("row"), F.count("*").alias("held"), F.min("size").alias("size"), *(F.min(c).alias(c) for c in leasts)))
    large = _large_cells(members)
    dense = _within_cells(rows, members, large, threshold, n) if any(map(len, large)) else None

    counts = texts.mapInArrow(_counted(threshold, n), "hash int, count int").groupBy("hash").agg(F.sum("count").alias("count")).where(F.col("count") > FREQUENT)
    counts = checkpoint(counts)
    frequent = spark.sparkContext.broadcast((*_frequent(counts, MAX_FREQUENT), large))
    drop_unused(spark)
    # Fewer, larger blocks of columns than shuffle partitions: a pair meets in fewer of them and has fewer partial sums.
    columns = max(1, parts // 2)
    entries = texts.mapInArrow(_entries(threshold, n, frequent, shared, columns), "part int, hashes array<int>, owners array<smallint>, marks array<int>, sets array<long>, cells array<long>")
    entry = entries.repartitionById(columns, "part").select(F.posexplode("hashes").alias("place", "hash"), "owners", "marks", "sets", "cells")
    own = F.get("owners", F.col("place")).cast("int")
    blocks = entry.select("hash", F.get("marks", own).alias("mark"), F.get("sets", own).alias("set"), F.get("cells", own).alias("cells")).sortWithinPartitions(F.shiftright("hash", 1), "mark", "set")
    sums = blocks.mapInArrow(_product(threshold, parts), "bucket int, pairs binary").repartition(parts, "bucket")
    pairs = checkpoint(sums.mapInArrow(_candidates(threshold), "a long, b long, size_a long, size_b long"))
    del entries, entry, blocks, sums
    drop_unused(spark)

    # Each pair goes where the least set lies that its left one is paired with; a clique of copies meets in one place.
    ends = pairs.select("a", "b", F.col("size_a").alias("size")).unionAll(pairs.select("b", "a", "size_b"))
    home = ends.groupBy("a").agg(F.least("a", F.min("b")).alias("home"), F.first("size").alias("size"))
    crowd = home.groupBy("home").agg(F.ceil(F.sum("size") / GRAMS_AT_ONCE).cast("int").alias("parts"))
    homes = checkpoint(home.join(crowd, "home").select("a", "home", "parts", "size"))
    count, grams = homes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = max(parts, -(-grams // GRAMS_AT_ONCE))
    task = F.pmod(F.xxhash64("home", F.pmod(F.xxhash64("a"), F.col("parts"))), F.lit(tasks))
    placed = checkpoint(_with(pairs, homes.drop("size"), "a", count).select(task.alias("task"), "a", "b", "size_a", "size_b"))
    wanted = placed.select("task", F.col("a").alias("set")).unionAll(placed.select("task", "b")).groupBy("set").agg(F.collect_set("task").alias("tasks"))
    chosen = members.select("set", "row").join(wanted, "set")
    shipped = _with(rows.select("text", "row"), chosen, "row", count).select("text", "tasks", "set").mapInArrow(_sets(n), "to_task long, set long, grams binary")
    counted = placed.groupBy("task").cogroup(shipped.groupBy("to_task")).applyInPandas(_overlaps, "a long, b long, size_a long, size_b long, overlap long")
    found = checkpoint(counted.where(F.col("overlap") >= threshold * (F.col("size_a") + F.col("size_b") - F.col("overlap")) - 1e-9).select("a", "b"))
    del ends, home, crowd, wanted, chosen, shipped, counted
    drop_unused(spark)

    sizes = _with(members.select("set", "held"), homes.select(F.col("a").alias("set")), "set", count)
    edges = found.unionAll(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = _with(edges, sizes.select(F.col("set").alias("b"), "held"), "b", count).select(F.col("a").alias("set"), F.col("held").alias("links"))
    if dense is not None:
        links = links.unionAll(dense.select("set", "links"))
        found = found.unionAll(dense.where("set <> near").select("set", "near"))
    return classes.select("row", "id", "set"), members.select("set", "held"), links.groupBy("set").agg(F.sum("links").alias("links")), found


def _first() -> Column:
    """The first row by id, nulls last, then by row."""
    return F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row"))


def _labels(pairs: DataFrame) -> DataFrame:
    """(set, label): the least set that each set in ``pairs`` is connected with, by hash-to-min rounds."""
    edges = checkpoint(pairs.select("a", "b").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = checkpoint(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("label")))
    while True:
        seen = edges.join(labels.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        hop = labels.select(F.col("a").alias("label"), F.col("label").alias("far"))
        after = checkpoint(
            labels.join(seen, "a").join(hop, "label").select("a", F.least("label", "near", "far").alias("label"), (F.least("near", "far") < F.col("label")).alias("moved"))
        )
        labels = after.select("a", "label")
        if after.where("moved").isEmpty():
            return labels.withColumnRenamed("a", "set")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """Rows (doc_id, class_id, n_links), one for each document: how many other documents are alike to at least ``threshold``, and its class.

    Every link counts, those between documents of equal sets of n-grams as well. A class is what links connect, and its id that
    of its first document by id, then by row.

    Defined cases: null texts and texts without words have no links and are classes by themselves; a text of fewer than n words
    is one n-gram; repeated rows are documents that are linked; null ids stay null and come last; texts of any length
    count whole; an empty table gives no rows; other columns are ignored.
    """
    rows = with_row_id(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), "row")
    classes, members, links, pairs = similar_sets(rows, threshold, n)
    firsts = classes.groupBy("set").agg(_first().alias("first"))
    sets = members.join(firsts, "set").join(_labels(pairs), "set", "left").join(links, "set", "left").withColumn("label", F.coalesce("label", "set"))
    heads = sets.groupBy("label").agg(F.min("first").alias("head"))
    sets = sets.join(heads, "label").select("set", F.col("head.id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("held") - 1).alias("n_links"))
    alike = classes.join(sets, "set").select(F.col("id").alias("doc_id"), "class_id", "n_links")
    alone = rows.select("row", "id").join(classes.select("row"), "row", "left_anti").select(F.col("id").alias("doc_id"), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return alike.unionAll(alone)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """``docs`` with one document of each group: the first by id (nulls last), then by row; columns stay.

    A group is connected by pairs of at least ``threshold``. Cases as in ``similar_documents``: null texts and texts
    without words all stay.
    """
    row = fresh(docs, "row")
    numbered = with_row_id(docs, row)
    classes, _, _, pairs = similar_sets(numbered.select(F.col(row).alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), threshold, n)
    grouped = classes.join(_labels(pairs), "set", "left").withColumn("label", F.coalesce("label", "set"))
    firsts = grouped.groupBy("label").agg(_first().alias("first"), F.count("*").alias("held")).where("held > 1")
    dropped = checkpoint(grouped.join(firsts, "label").where("row <> first.row").select(F.col("row").alias(row)))
    del classes, pairs, grouped, firsts, _
    drop_unused(docs.sparkSession)
    # Texts needn't cross the network to lose the rows that few others name.
    return numbered.join(F.broadcast(dropped) if dropped.count() <= BROADCAST_ROWS else dropped, row, "left_anti").drop(row)
