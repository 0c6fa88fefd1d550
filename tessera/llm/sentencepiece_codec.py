"""SentencePiece encoding and decoding by shared-prefix Viterbi.

Blanks become marks and a text falls into marked words, across which no piece of the model reaches. The
distinct words of a batch are sorted, which lays them out as a trie in depth-first order: the forward state
of a common prefix stays on a stack while its subtree lasts and only characters after it are worked out.

The forward state of a prefix depends on the kind of model. For unigram models it is the best score and the
piece that gives it. Scores of a BPE model are merge ranks, whose sums mean nothing; there the state is the
last piece of the prefix's own merge result. It is the one piece that ends there and that merging leaves apart
from the state before it, so the same recursion gives the library's ids, not just some segmentation.

Encoding is a map over batches, without a shuffle. Models are read on the driver; each worker gets their bytes,
of a fixed size.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNIGRAM, BPE = 1, 2
#: A unigram model charges an unknown character this much more than its worst piece.
UNKNOWN_PENALTY = 10.0
#: Pairs of pieces whose merging is remembered in a worker; it forgets all beyond that.
REMEMBERED = 500_000
#: Words turned into ids at once, which bounds what one batch holds in memory.
WORDS_AT_ONCE = 500_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a serialized message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


class Codec:
    """Encoder and decoder of one serialized model of the unigram or BPE kind."""

    def __init__(self, model: bytes) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = self.library.get_piece_size()
        names = [self.library.id_to_piece(i) for i in range(size)]
        byte = [self.library.is_byte(i) for i in range(size)]
        special = [self.library.is_control(i) or self.library.is_unknown(i) for i in range(size)]
        top = dict(_fields(model))
        self.kind = dict(_fields(top.get(2, b""))).get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models can be encoded")
        normal = dict(_fields(top.get(3, b"")))
        self.prefix = bool(normal.get(3, 1))
        self.plain = not normal.get(2) and not normal.get(4, 1) and bool(normal.get(5, 1))
        self.ids = {p: i for i, p in enumerate(names) if not byte[i] and not special[i] and not self.library.is_unused(i)}
        self.scores = [self.library.get_score(i) for i in range(size)]
        self.suffixes = {p[k:] for p in self.ids for k in range(len(p))}
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if any(byte) else None
        self.unknown = self.library.unk_id()
        self.unknown_score = min((self.scores[i] for i in self.ids.values()), default=0.0) - UNKNOWN_PENALTY
        inside = any(MARK in p.lstrip(MARK) for p in self.ids)
        lines = self.bytes and not any("\n" in p for p in self.ids)
        self.words = re.compile("(?s).+" if inside else f"{MARK}*[^{MARK}\n]+|{MARK}+|\n" if lines else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.apart: dict[int, bool] = {}
        self.whole = {i: self._merge(p) == [p] for p, i in self.ids.items()} if self.kind == BPE else {}
        plain = [b"" if special[i] else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        self.parts = [bytes([int(p[3:5], 16)]) if byte[i] else plain[i] for i, p in enumerate(names)]

    def marked(self, text: str) -> str:
        if not self.plain:
            return self.library.normalize(text)
        return (MARK if self.prefix and text else "") + text.replace(" ", MARK)

    def _merge(self, word: str) -> list[str]:
        """Byte-pair merging by its definition: best score first, then leftmost."""
        parts = list(word)
        while True:
            best = None
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best[0]):
                    best = (self.scores[i], k)
            if best is None:
                return parts
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    def _stay_apart(self, left: int, right: int, left_piece: str, right_piece: str) -> bool:
        key = left * len(self.scores) + right
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) >= REMEMBERED:
                self.apart.clear()
            known = self.apart[key] = self._merge(left_piece + right_piece) == [left_piece, right_piece]
        return known

    def encode_sorted(self, words: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and the number of each word's; words come sorted."""
        flat, counts = array("i"), array("i")
        forward = self._forward_bpe if self.kind == BPE else self._forward_unigram
        # The stack: for each prefix of the current path its last piece (-1: an unknown character), its length and score.
        piece, length, score = [0], [0], [0.0]
        before = ""
        for word in words:
            common, most = 0, min(len(before), len(word))
            while common < most and before[common] == word[common]:
                common += 1
            del piece[common + 1 :], length[common + 1 :], score[common + 1 :]
            for end in range(common + 1, len(word) + 1):
                forward(word, end, piece, length, score)
            found, at = [], len(word)
            while at:
                if piece[at] >= 0:
                    found.append(piece[at])
                elif self.bytes:
                    found.extend(self.bytes[b] for b in reversed(word[at - 1].encode("utf-8", "replace")))
                elif not found or found[-1] != self.unknown:
                    found.append(self.unknown)
                at -= length[at]
            found.reverse()
            flat.extend(found)
            counts.append(len(found))
            before = word
        return np.frombuffer(flat, np.int32) if flat else np.empty(0, np.int32), np.frombuffer(counts, np.int32) if counts else np.empty(0, np.int32)

    def _ending(self, word: str, end: int) -> list[tuple[int, int]]:
        """(length, id) of the pieces that end at ``end``, shortest first."""
        found, start = [], end - 1
        while start >= 0 and (part := word[start:end]) in self.suffixes:
            if (i := self.ids.get(part)) is not None:
                found.append((end - start, i))
            start -= 1
        return found

    def _forward_bpe(self, word: str, end: int, piece: list, length: list, score: list) -> None:
        for size, i in reversed(self._ending(word, end)):
            start = end - size
            if start == 0 or piece[start] < 0:
                fits = self.whole[i]
            else:
                fits = self._stay_apart(piece[start], i, word[start - length[start] : start], word[start:end])
            if fits:
                piece.append(i)
                length.append(size)
                score.append(0.0)
                return
        piece.append(-1)
        length.append(1)
        score.append(0.0)

    def _forward_unigram(self, word: str, end: int, piece: list, length: list, score: list) -> None:
        best, choice, size = None, -1, 1
        ending = self._ending(word, end)
        if not ending or ending[0][0] > 1:
            best = score[end - 1] + self.unknown_score
        for n, i in reversed(ending):
            if best is None or score[end - n] + self.scores[i] > best:
                best, choice, size = score[end - n] + self.scores[i], i, n
        piece.append(choice)
        length.append(size)
        score.append(best)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the number of each text's."""
        numbers = _Numbers()
        codes = [np.fromiter(map(numbers.__getitem__, self.words.findall(self.marked(t))), np.int32) for t in texts]
        distinct = sorted(numbers)
        order = np.fromiter(map(numbers.__getitem__, distinct), np.int64, len(distinct))
        flat, counts = self.encode_sorted(distinct)
        start, size = np.zeros(len(order), np.int64), np.zeros(len(order), np.int32)
        size[order] = counts
        start[order] = np.cumsum(counts, dtype=np.int64) - counts
        out, lengths, held, words = [], np.zeros(len(texts), np.int64), [], 0
        for k, own in enumerate([*codes, None]):
            if own is None or words + len(own) > WORDS_AT_ONCE:
                if held:
                    group = np.concatenate(held)
                    n = size[group]
                    shift = start[group] - (np.cumsum(n, dtype=np.int64) - n)
                    out.append(flat[np.repeat(shift, n) + np.arange(n.sum(dtype=np.int64))])
                held, words = [], 0
            if own is not None:
                lengths[k] = size[own].sum(dtype=np.int64)
                held.append(own)
                words += len(own)
        return np.concatenate(out) if out else np.empty(0, np.int32), lengths

    def decode(self, ids: Iterable[int]) -> str:
        """The text of some ids; broken UTF-8 becomes replacement characters, ids out of range nothing."""
        parts = self.parts
        try:
            text = b"".join(map(parts.__getitem__, ids))
        except IndexError:
            text = b"".join(parts[i] for i in ids if 0 <= i < len(parts))
        return text.decode("utf-8", "replace")[1 if self.prefix and text[:1] == b" " else 0 :]


class _Numbers(dict):
    """Numbers words in order of appearance."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


_loaded: dict[int, Codec] = {}


def codec(model: bytes) -> Codec:
    """The worker's codec of this model, made once."""
    if (key := hash(model)) not in _loaded:
        _loaded.clear()
        _loaded[key] = Codec(model)
    return _loaded[key]


def read_model(path: str = MODEL_FILE) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode(docs: DataFrame, model_file: str = MODEL_FILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_tokens, ids, exact): the ids of each text, and whether decoding them gives the text back.

    Of segmentations of equal score a unigram model's is the one whose last piece, then the one before it and so on, is longer.

    Defined cases: a null text has null ``ids``, ``n_tokens`` and ``exact``; an empty one has no ids; ``exact``
    is false where a text holds the mark itself, which decodes to a blank; repeated rows and null ids stay as they
    are; texts of any length are encoded whole; an empty table gives no rows; other columns are ignored.
    """
    model = read_model(model_file)
    kind = docs.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField("doc_id", kind), T.StructField("n_tokens", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("exact", T.BooleanType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            flat, lengths = own.encode([t or "" for t in texts])
            ends = np.cumsum(lengths)
            exact = [None if t is None else own.decode(flat[e - n : e].tolist()) == t for t, n, e in zip(texts, lengths, ends)]
            null = np.array([t is None for t in texts], bool)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat), mask=pa.array(null))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths.astype(np.int32), mask=null), ids, pa.array(exact, pa.bool_())], names=["doc_id", "n_tokens", "ids", "exact"]
            )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def decode(tokens: DataFrame, model_file: str = MODEL_FILE, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (doc_id, text): the text of each list of ids.

    Defined cases: null ids give a null text, an empty list the empty text; null members and ids the model
    doesn't have are skipped; other columns are ignored.
    """
    model = read_model(model_file)
    schema = T.StructType([T.StructField("doc_id", tokens.schema[id_col].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            texts = [None if ids is None else own.decode([i for i in ids if i is not None and i >= 0]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, schema)
