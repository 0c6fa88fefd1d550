"""Token-ID output as one compressed wavelet matrix per shard.

A wavelet matrix keeps a sequence of token ids as one bit-plane per bit of an id, from the highest down; before each
lower plane the tokens are stably parted by the bit just stored. With ranks over the planes the file answers, without
being expanded: the token at a place, how often a token occurs before a place, and the place of its k-th occurrence.

A shard is a run of documents of one input split, closed once it holds ``shard_tokens`` tokens, so output needs no
shuffle and a file's size is bounded by the target plus one document. Texts are tokenised whole in the worker
that packs them.

File layout (little endian): magic, counts, compressed id list of documents and their ends, then for each plane the
number of zeros and the places of its blocks, then the blocks. A block is ``BLOCK_BITS`` bits, compressed by itself,
with the rank before it kept beside it; a query opens one or two blocks per plane.
"""

from __future__ import annotations

import base64
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANKS_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Production size of a shard; the file of 8 million 16-bit ids is about 16 MB before compression.
SHARD_TOKENS = 8_000_000
BLOCK_BITS = 1 << 18
MAGIC = b"WVM1"


class Tokenizer:
    """Byte-level BPE ids of texts, without special tokens: their strings are ordinary text."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 1

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_ordinary(text), np.uint32)

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


def read_ranks(path: str = RANKS_FILE) -> bytes:
    with open(path, "rb") as file:
        return file.read()


_loaded: dict[int, Tokenizer] = {}


def tokenizer(ranks: bytes) -> Tokenizer:
    """The worker's tokenizer, made once."""
    if (key := hash(ranks)) not in _loaded:
        _loaded.clear()
        _loaded[key] = Tokenizer({base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())})
    return _loaded[key]


def build(tokens: np.ndarray, doc_ids: list, ends: list[int], size: int) -> bytes:
    """The file of a shard: ``tokens`` of all its documents, document ``doc_ids[k]`` ending before ``ends[k]``."""
    packer = zstandard.ZstdCompressor(level=3)
    planes = max(1, (max(size, 2) - 1).bit_length())
    current = np.ascontiguousarray(tokens, np.uint32)
    heads, blocks = [], []
    for plane in range(planes - 1, -1, -1):
        bits = (current >> np.uint32(plane)).astype(np.uint8) & np.uint8(1)
        ones, at, own = 0, 0, []
        for k in range(0, len(bits), BLOCK_BITS):
            part = bits[k : k + BLOCK_BITS]
            packed = packer.compress(np.packbits(part, bitorder="little").tobytes())
            own.append((ones, len(packed)))
            ones += int(part.sum(dtype=np.int64))
            blocks.append(packed)
        heads.append(struct.pack("<QI", len(bits) - ones, len(own)) + b"".join(struct.pack("<QI", *b) for b in own))
        keep = bits == 0
        current = np.concatenate([current[keep], current[~keep]])
    meta = packer.compress(json.dumps({"ids": doc_ids, "ends": ends}).encode())
    return MAGIC + struct.pack("<QIII", len(tokens), planes, BLOCK_BITS, len(meta)) + meta + b"".join(heads) + b"".join(blocks)


class WaveletFile:
    """Reads a shard's file: ``access``, ``rank``, ``select``, ``count`` and whole documents."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet file")
        self.length, self.planes, self.block_bits, size = struct.unpack_from("<QIII", data, 4)
        at = 24 + size
        self.data, self.unpacker = data, zstandard.ZstdDecompressor()
        meta = json.loads(self.unpacker.decompress(data[24:at]))
        self.doc_ids, self.ends = meta["ids"], meta["ends"]
        self.zeros, index = [], []
        for _ in range(self.planes):
            zeros, n = struct.unpack_from("<QI", data, at)
            self.zeros.append(zeros)
            index.append([struct.unpack_from("<QI", data, at + 12 + 12 * k) for k in range(n)])
            at += 12 + 12 * n
        self.index: list[list[tuple[int, int, int]]] = []
        for own in index:
            placed = []
            for ones, n in own:
                placed.append((ones, at, n))
                at += n
            self.index.append(placed)
        self.opened: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def _block(self, plane: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Bits of a block and, for every 512 of them, the ones before."""
        if (plane, k) not in self.opened:
            if len(self.opened) >= 64:
                self.opened.clear()
            _, at, n = self.index[plane][k]
            size = min(self.block_bits, self.length - k * self.block_bits)
            packed = np.frombuffer(self.unpacker.decompress(self.data[at : at + n]), np.uint8)
            bits = np.unpackbits(packed, count=size, bitorder="little")
            self.opened[plane, k] = bits, np.concatenate([[0], np.add.reduceat(bits, np.arange(0, size, 512), dtype=np.int64).cumsum()])
        return self.opened[plane, k]

    def _bit(self, plane: int, i: int) -> int:
        return int(self._block(plane, i // self.block_bits)[0][i % self.block_bits])

    def _ones(self, plane: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        k, rest = divmod(i, self.block_bits)
        if k == len(self.index[plane]):
            return self.length - self.zeros[plane]
        bits, sums = self._block(plane, k)
        return self.index[plane][k][0] + int(sums[rest // 512]) + int(bits[rest // 512 * 512 : rest].sum(dtype=np.int64))

    def _select(self, plane: int, bit: int, ks: np.ndarray) -> np.ndarray:
        """Places of the k-th (from 0) bits of a kind in a plane, for ascending ``ks``: the counts kept with the blocks say which to open."""
        before = np.array([ones for ones, _, _ in self.index[plane]], np.int64)
        if not bit:
            before = np.arange(len(before)) * self.block_bits - before
        which = np.searchsorted(before, ks, side="right") - 1
        out = np.empty(len(ks), np.int64)
        for k in np.unique(which):
            own = which == k
            out[own] = k * self.block_bits + np.flatnonzero(self._block(plane, int(k))[0] == bit)[ks[own] - before[k]]
        return out

    def access(self, i: int) -> int:
        """The token at place ``i``."""
        if not 0 <= i < self.length:
            raise IndexError(i)
        token = 0
        for p in range(self.planes):
            bit = self._bit(p, i)
            ones = self._ones(p, i)
            token = token << 1 | bit
            i = self.zeros[p] + ones if bit else i - ones
        return token

    def _path(self, token: int) -> Iterator[tuple[int, int]]:
        for p in range(self.planes):
            yield p, token >> (self.planes - 1 - p) & 1

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        for p, bit in self._path(token):
            a, b = self._ones(p, start), self._ones(p, end)
            start, end = (self.zeros[p] + a, self.zeros[p] + b) if bit else (start - a, end - b)
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of a token in places ``start`` to ``end`` (exclusive)."""
        if token < 0 or token >> self.planes:
            return 0
        end = self.length if end is None else min(end, self.length)
        a, b = self._range(token, start, end) if start < end else (0, 0)
        return b - a

    def rank(self, token: int, i: int) -> int:
        """Occurrences of a token before place ``i``."""
        return self.count(token, 0, i)

    def select(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of a token; -1 if there are fewer."""
        if k < 0 or token < 0 or token >> self.planes:
            return -1
        places = self._places(token, k, k + 1)
        return int(places[0]) if len(places) else -1

    def _places(self, token: int, first: int, last: int) -> np.ndarray:
        """Places of the occurrences ``first`` to ``last`` (exclusive) of a token; they stay in order from plane to plane."""
        start, end = self._range(token, 0, self.length)
        at = np.arange(start + first, min(start + last, end))
        for p, bit in reversed(list(self._path(token))):
            at = self._select(p, bit, at - self.zeros[p] if bit else at)
        return at

    def occurrences(self, token: int) -> list[tuple[int, int]]:
        """(number of the document in the file, place in it) of every occurrence."""
        places = self._places(token, 0, self.length).tolist() if 0 <= token < 1 << self.planes else []
        docs = np.searchsorted(np.array(self.ends), places, side="right")
        return [(int(d), p - (self.ends[d - 1] if d else 0)) for d, p in zip(docs, places)]

    def tokens(self) -> np.ndarray:
        """All tokens, read back plane by plane."""
        places, out = np.arange(self.length), np.zeros(self.length, np.uint32)
        for p in range(self.planes):
            bits = np.concatenate([self._block(p, k)[0] for k in range(len(self.index[p]))]) if self.length else np.empty(0, np.uint8)
            ones = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])[:-1] if self.length else np.empty(0, np.int64)
            own, before = bits[places], ones[places]
            out = out << np.uint32(1) | own
            places = np.where(own == 1, self.zeros[p] + before, places - before)
        return out

    def document(self, k: int) -> list[int]:
        """Tokens of the k-th document, by access alone."""
        return [self.access(i) for i in range(self.ends[k - 1] if k else 0, self.ends[k])]


def write_shards(docs: DataFrame, ranks_file: str = RANKS_FILE, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Rows (split, shard, doc_ids, n_tokens, n_bytes, file): the wavelet files that hold all texts of ``docs``.

    ``(split, shard)`` names a file; ``doc_ids`` lists its documents in order, ``n_bytes`` counts their text in UTF-8.

    Defined cases: a null text is kept as a document without tokens, like an empty one; null ids and repeated rows
    are documents like any other; a text longer than a shard has one of its own; an empty table gives no files; other
    columns are ignored.
    """
    ranks = read_ranks(ranks_file)
    kind = docs.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField("split", T.IntegerType()),
            T.StructField("shard", T.IntegerType()),
            T.StructField("doc_ids", T.ArrayType(kind)),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("file", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(ranks)
        held: list[np.ndarray] = []
        ids: list = []
        ends: list[int] = []
        shard = total = n_bytes = split = 0
        arrow = None

        def close() -> pa.RecordBatch:
            tokens = np.concatenate(held) if held else np.empty(0, np.uint32)
            plain = [i if i is None or isinstance(i, int | float | str) else str(i) for i in ids]
            file = build(tokens, plain, ends, own.size)
            columns = [pa.array([split], pa.int32()), pa.array([shard], pa.int32()), pa.array([ids], pa.list_(arrow)), pa.array([len(tokens)]), pa.array([n_bytes]), pa.array([file], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:
            arrow = batch.schema.field(0).type
            for doc, text, split in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                tokens = own.encode(text or "")
                if ids and total + len(tokens) > shard_tokens:
                    yield close()
                    held, ids, ends, shard, total, n_bytes = [], [], [], shard + 1, 0, 0
                held.append(tokens)
                ids.append(doc)
                total += len(tokens)
                ends.append(total)
                n_bytes += len((text or "").encode("utf-8", "replace"))
        if ids:
            yield close()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.spark_partition_id().alias("split")).mapInArrow(run, schema)
