"""Substring deduplication by relative Lempel-Ziv parsing.

Each document is parsed from left to right against indexed blocks of the documents before it (by id, then by row). A run of
``min_words`` words, a seed, is indexed at its first place; the reference blocks of a document are the documents that first had any of
its seeds, at the alignment of that place, as far as they agree with it to either side. Where the parse stands, the next factor is the longest run of words that
one reference block has, and the parse goes on at the factor's end. At a factor's boundary the match is checked to the left as
well: a factor counts if it and the words before it that its source has too come to ``min_words``, so a passage that begins inside
the factor before isn't lost. Where nothing that long covers the next word, the parse moves on to the first word that
one does. Factors are disjoint, and together they cover every word that stands in a repeated passage of ``min_words`` words.

The index is made in steps, none of which compares documents in pairs:

1. Anchors. Every run of ``k`` words has a hash, and of each ``w`` neighbouring runs the least is an anchor. With
   k + w - 1 = min_words every passage of that length has the same anchor wherever it is, so anchors that occur in one
   document alone need no further look. They are about one word in w / 2.
2. Seeds. Around anchors that two documents share, every seed that holds the anchor gets a hash. The first place of
   a seed is its name, each later one is a match.
3. Chains. Successive matches of a document that have successive first places in one document (itself too) are a chain. Two documents have
   the same words somewhere exactly if their seeds have the same names there, so how far a reference block agrees
   with a document is read from the chains of both.

Work and shuffles grow with the words of the corpus, and a passage of thousands of copies is a run of thousands of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint, shuffle_partitions, with_row_number
from tessera.llm.grams import BASE, SECOND_BASE, codes, run_hashes

MIN_WORDS = 50


def _sizes(min_words: int) -> tuple[int, int]:
    """(k, w): words of an anchor, and neighbouring runs of which the least is one."""
    k = max(1, min_words // 2)
    return k, min_words - k + 1


def _sliding(x: np.ndarray, w: int, best: np.ufunc) -> np.ndarray:
    """The least or greatest of each ``w`` neighbours, by doubling."""
    size = 1
    while size < w:
        step = min(size, w - size)
        x = best(x[:-step], x[step:])
        size += step
    return x


def anchors(words: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the runs of ``k`` words that are the least among some ``w`` neighbours."""
    h = run_hashes(words, k)
    if len(h) < w:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    least = _sliding(h, w, np.minimum)
    # The window minima a run takes part in: it is an anchor if the greatest of them is its own hash.
    padded = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    places = np.flatnonzero(_sliding(padded, w, np.maximum) == h)
    return places, h[places]


def _anchor_rows(min_words: int):  # noqa: ANN202
    k, w = _sizes(min_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hashes, places = [], [], []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = text.split()
                if len(words) >= min_words:
                    at, h = anchors(codes(words), k, w)
                    rows.append(np.full(len(at), row, np.int64))
                    hashes.append(h.view(np.int64))
                    places.append(at.astype(np.int32))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes)), pa.array(np.concatenate(rows)), pa.array(np.concatenate(places))], names=["hash", "row", "pos"])

    return run


def _seed_rows(min_words: int):  # noqa: ANN202
    k, _ = _sizes(min_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hashes, tails = [], [], []
            for row, text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = codes(text.split())
                first = run_hashes(words, min_words, BASE)
                near = np.zeros(len(first) + 1, np.int32)
                at = np.array(places, np.int64)
                np.add.at(near, np.minimum(np.maximum(at + k - min_words, 0), len(first)), 1)
                np.add.at(near, np.minimum(at + 1, len(first)), -1)
                starts = np.flatnonzero(np.cumsum(near[:-1]) > 0)
                second = run_hashes(words, min_words, SECOND_BASE)[starts] >> np.uint64(32)
                rows.append(np.full(len(starts), row, np.int64))
                hashes.append(first[starts].view(np.int64))
                tails.append((second << np.uint64(32) | starts.astype(np.uint64)).view(np.int64))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes)), pa.array(np.concatenate(tails)), pa.array(np.concatenate(rows))], names=["hash", "tail", "doc"])

    return run


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, start, seeds, ref, ref_start) of the chains in matches (doc, pos, ref, ref_pos) sorted by (doc, pos).

    The last chain of a batch waits for the next one, which may go on with it.
    """
    names = ["doc", "start", "seeds", "ref", "ref_start"]
    held: list[np.ndarray] | None = None
    for batch in batches:
        doc, pos, ref, there = (c.to_numpy().astype(np.int64) for c in batch.columns)
        if not len(doc):
            continue
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1) | (ref[1:] != ref[:-1]) | (there[1:] != there[:-1] + 1)
        starts = np.flatnonzero(new)
        found = [doc[starts], pos[starts], np.diff(np.append(starts, len(doc))), ref[starts], there[starts]]
        if held is not None:
            size = held[2][-1]
            if (held[0][-1], held[1][-1] + size, held[3][-1], held[4][-1] + size) == (doc[0], pos[0], ref[0], there[0]):
                held[2][-1] += found[2][0]
                found = [f[1:] for f in found]
            found = [np.concatenate([h, f]) for h, f in zip(held, found)]
        held = [f[-1:].copy() for f in found]
        yield pa.RecordBatch.from_arrays([pa.array(f[:-1]) for f in found], names=names)
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array(h) for h in held], names=names)


Chains = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _agreements(own: Chains, others: dict[int, Chains]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first seed, last seed, source, its place less the document's) of the runs of seeds that reference blocks share with a document.

    Chains are (starts, seeds, refs, ref_starts); ``others`` has those of the sources that have any.
    """
    starts, sizes, refs, there = own
    ends, apart = starts + sizes - 1, there - starts
    # Where two documents agree their seeds have one name: the same first document, at the same place.
    key = refs * 0x5851F42D4C957F2D + apart
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    found = [(starts, ends, refs, apart)]
    for source, shift in sorted(set(zip(refs.tolist(), apart.tolist()))):
        other = others.get(source)
        if other is None:
            continue
        c, n, z, w = other
        first, last, alike = c - shift, c - shift + n - 1, w - c + shift
        theirs = z * 0x5851F42D4C957F2D + alike
        low, high = np.searchsorted(sorted_key, theirs), np.searchsorted(sorted_key, theirs, side="right")
        count = high - low
        if not count.any():
            continue
        j = np.repeat(np.arange(len(c)), count)
        k = order[np.arange(len(j)) - np.repeat(np.cumsum(count) - count, count) + low[j]]
        a, b = np.maximum(starts[k], first[j]), np.minimum(ends[k], last[j])
        fits = (a <= b) & (refs[k] == z[j]) & (apart[k] == alike[j])
        found.append((a[fits], b[fits], np.full(fits.sum(), source), np.full(fits.sum(), shift)))
    a, b, source, shift = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((a, shift, source))
    a, b, source, shift = a[order], b[order], source[order], shift[order]
    new = np.ones(len(a), bool)
    new[1:] = (source[1:] != source[:-1]) | (shift[1:] != shift[:-1]) | (a[1:] != b[:-1] + 1)
    at = np.flatnonzero(new)
    return a[at], b[np.append(at[1:], len(a)) - 1], source[at], shift[at]


def parse(own: Chains, others: dict[int, Chains], min_words: int) -> list[tuple[int, int, int, int]]:
    """(start, end, source, source's start) of the factors of a document, from its chains and those of their sources."""
    a, b, source, shift = _agreements(own, others)
    order = np.lexsort((shift, source, -b, a))
    runs = list(zip(a[order].tolist(), (b[order] + min_words).tolist(), source[order].tolist(), shift[order].tolist()))
    out = []
    at, best = 0, (0, 0, 0)
    for k, (start, end, *rest) in enumerate([*runs, (1 << 62, 0, 0, 0)]):
        # All runs that begin at or before ``at`` have been seen: the one that reaches furthest is the factor.
        while start > at:
            if -best[0] > at:
                out.append((at, -best[0], best[1], at + best[2]))
                at = -best[0]
            elif k < len(runs):
                at = start
            else:
                return out
        best = min(best, (-end, *rest))
    return out


def _parsed(min_words: int):  # noqa: ANN202
    def columns(chains: pa.StructArray) -> Chains:
        return tuple(chains.field(c).to_numpy() for c in ("start", "seeds", "ref", "ref_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # Chains stay in Arrow's memory and are read in place; as Python objects they would take ten times as much.
            batch = pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in whole.columns], names=whole.schema.names)
            docs, mine, theirs = batch.columns
            own, bounds = columns(mine.values), mine.offsets.to_numpy()
            refs, chains = theirs.values.field("ref").to_numpy(), theirs.values.field("chains")
            others, starts, inner = columns(chains.values), theirs.offsets.to_numpy(), chains.offsets.to_numpy()
            out = []
            for k, doc in enumerate(docs.to_numpy()):
                known = {int(refs[i]): tuple(c[inner[i] : inner[i + 1]] for c in others) for i in range(starts[k], starts[k + 1]) if inner[i] < inner[i + 1]}
                found = parse(tuple(c[bounds[k] : bounds[k + 1]] for c in own), known, min_words)
                if found:
                    out.append(np.column_stack([np.full(len(found), doc), np.array(found, np.int64)]))
            columns_of = np.concatenate(out).T if out else np.empty((5, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns_of], names=["doc", "start", "end", "ref", "ref_start"])

    return run


def factors(rows: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """((doc, start, end, ref, ref_start), (doc, id)) for rows (row, id, text): the factors that count, and the documents they name.

    Places count words, ends are exclusive; ``row`` is a unique long, ``doc`` one that grows with (id, row), null ids last.
    """
    parts = shuffle_partitions(rows.sparkSession)
    texts = rows.where(F.col("text").isNotNull()).select("row", "text")
    found = texts.mapInArrow(_anchor_rows(min_words), "hash long, row long, pos int")
    same = Window.partitionBy("hash")
    shared = found.withColumn("low", F.min("row").over(same)).withColumn("high", F.max("row").over(same)).where("low < high")
    regions = shared.groupBy("row").agg(F.collect_list("pos").alias("places")).join(rows.select("row", "id"), "row")
    order = [F.col("id").isNull(), F.col("id"), F.col("row")]
    regions = checkpoint(regions.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("doc", F.monotonically_increasing_id()))

    seeds = texts.join(regions, "row").select("doc", "text", "places").mapInArrow(_seed_rows(min_words), "hash long, tail long, doc long")
    # 96 bits name a seed: 64 of one hash and 32 of another; the place is in the lower half of the tail. Seeds are spread
    # before the tail is taken apart, which keeps them to three longs on the way.
    seeds = seeds.repartition(parts, "hash").select("hash", F.shiftright("tail", 32).cast("int").alias("more"), F.col("tail").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("pos"), "doc")
    first = F.min(F.struct("doc", "pos")).over(Window.partitionBy("hash", "more"))
    # A document's own repeats are no factors, but part of what names its seeds.
    matched = seeds.withColumn("ref", first).where("ref.doc < doc OR ref.pos < pos").select("doc", "pos", F.col("ref.doc").alias("ref"), F.col("ref.pos").alias("ref_pos"))
    chains = matched.repartition(parts, "doc").sortWithinPartitions("doc", "pos").mapInArrow(_chains, "doc long, start long, seeds long, ref long, ref_start long")
    own = checkpoint(checkpoint(chains).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "seeds", "ref", "ref_start"))).alias("chains")))
    mine = own.select("doc", F.filter("chains", lambda c: c["ref"] != F.col("doc")).alias("chains")).where(F.size("chains") > 0)
    sources = mine.select("doc", F.explode(F.array_distinct(F.transform("chains", lambda c: c["ref"]))).alias("ref"))
    theirs = sources.join(own.select(F.col("doc").alias("ref"), F.col("chains")), "ref").groupBy("doc").agg(F.collect_list(F.struct("ref", "chains")).alias("others"))
    parsed = mine.join(theirs, "doc", "left").select("doc", "chains", "others").mapInArrow(_parsed(min_words), "doc long, start long, end long, ref long, ref_start long")
    return checkpoint(parsed), regions.select("doc", "id")


def duplicate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Rows (doc_id, start_word, end_word, ref_doc_id, ref_start_word): factors of documents that an earlier document has too.

    Earlier means a lower id, or the same one in an earlier row; null ids come last. A factor goes from where the parse stands
    to the end of the longest match, text cut at white space; of several sources of one length the first counts, and its
    first such place. With the words before it that the source has as well it has at least ``min_words`` words.

    Defined cases: null texts and texts of fewer words have no spans; a repeated row is a copy of the first; a passage
    repeated within one document only isn't reported; texts of any length are parsed whole; an empty table gives no rows; other
    columns are ignored.
    """
    rows = with_row_number(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), "row")
    found, names = factors(rows, min_words)
    mine, other = names.select("doc", F.col("id").alias("doc_id")), names.select(F.col("doc").alias("ref"), F.col("id").alias("ref_doc_id"))
    place = lambda c, name: F.col(c).cast("int").alias(name)
    return found.join(mine, "doc").join(other, "ref").select("doc_id", place("start", "start_word"), place("end", "end_word"), "ref_doc_id", place("ref_start", "ref_start_word"))
