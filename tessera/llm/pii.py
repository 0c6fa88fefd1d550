"""Information-theoretic sanitisation of personal data.

Protected entities are identifiers in the text: mail and network addresses, phone and card numbers, keys and passwords,
each however it is written, and the domains of mail addresses. Identifiers are always replaced by a label of their kind. Words
beside them may give them away too, and the corpus says how much: a word discloses an entity by their pointwise mutual
information,

    log2(p(entity | word) / p(entity)), which leaves -log2 p(entity | word) of the entity's information content open,

where p(entity | word) is the share of the word's occurrences in the corpus that have the entity within ``WINDOW``
words. Where at most ``GENERALISE`` bits are left open a word is replaced by the class it belongs to ([NAME], [NUMBER], ...)
wherever it occurs; where it is at most ``REMOVE`` bits it is taken out.

A share seen a few times only says little: in a corpus of rare words nearly every neighbour of a rare number would seem to
reveal it. The share is therefore taken at the lower end of its (Wilson) confidence interval, given the number of different
contexts, in which copies of a document count once. All counts run over the whole corpus: pairs within windows, then
every occurrence of the words in them.
"""

from __future__ import annotations

import math
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator, Mapping

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import checkpoint, with_row_id

WINDOW = 5
#: Bits of an entity's information content that a disclosing word leaves open at most.
GENERALISE = 1.6
REMOVE = 1.0
#: Standard deviations between a share and its lower bound.
Z = 1.96
#: Disclosing words that are sent to every worker; beyond that documents are joined with theirs.
BROADCAST_TERMS = 500_000

_KINDS = (
    ("KEY", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("KEY", r"\b(?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,})"),
    ("SECRET", r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key))[\"']?[^\S\n]*[=:][^\S\n]*(?:\"[^\"\n]{4,}\"|'[^'\n]{4,}'|[^\s\"']{4,})"),
    ("IBAN", r"\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?\b"),
    ("SSN", r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])"),
    ("CARD", r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-]|\.\d)"),
    ("PHONE", r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<![\w.])\+\d{1,3}[ .-]?\d{2,4}(?:[ .-]?\d{2,4}){2,3}(?!\w)|(?<![\d.-])\d{3}-\d{3}-\d{4}(?![\d-])"),
    ("IP", r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)"),
)
_ANY = re.compile("|".join(f"(?P<k{i}>{p})" for i, (_, p) in enumerate(_KINDS)))
#: Characters without one of which no identifier is there: a quick look that spares most texts the rest.
_HINT = re.compile(r"[0-9@=]|[Kk][Ee][Yy]|[Pp][Aa][Ss][Ss]|[Pp][Ww][Dd]|[Ss][Ee][Cc][Rr]|[Tt][Oo][Kk][Ee][Nn]|gh[pousr]_|xox|sk-")
_WORD = re.compile(r"[^\W_]+")
#: What follows the @ of a mail address.
_DOMAIN = re.compile(r"(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")
_BEGIN = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
_END = re.compile(r"-----END [A-Z ]*PRIVATE KEY-----")


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _iban(code: str) -> bool:
    code = code.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _mails(text: str) -> list[tuple[int, int, str]]:
    """Mail addresses, each found from its @ outwards, so that long unbroken runs are read once."""
    found, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and (text[start - 1].isalnum() or text[start - 1] in "_.+%-"):
            start -= 1
        while start < at and not (text[start].isascii() and text[start].isalnum()):
            start += 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, m.end(), "EMAIL"))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)
    return found


def _private_keys(text: str) -> list[tuple[int, int, str]]:
    found, at = [], 0
    while (m := _BEGIN.search(text, at)) and (end := _END.search(text, m.end())):
        found.append((m.start(), end.end(), "KEY"))
        at = end.end()
    return found


def _valid(kind: str, value: str) -> bool:
    if kind == "CARD":
        return _luhn(re.sub(r"\D", "", value))
    if kind == "IBAN":
        return _iban(value)
    return kind != "IP" or all(int(x) <= 255 for x in value.split("."))


def identifiers(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the identifiers in a text, in order; numbers that fail their check digit are none.

    Of overlapping ones the first by its start counts, mail addresses and private keys before others of the same start.
    """
    if not _HINT.search(text):
        return []
    fixed = sorted(_mails(text) + _private_keys(text)) if "@" in text or "PRIVATE KEY" in text else []
    found: list[tuple[int, int, str]] = []
    at, k = 0, 0
    m = _ANY.search(text)
    while m or k < len(fixed):
        if k < len(fixed) and (not m or fixed[k][0] <= m.start()):
            if fixed[k][0] >= at:
                found.append(fixed[k])
                at = fixed[k][1]
                if m and m.start() < at:
                    m = _ANY.search(text, at)
            k += 1
            continue
        kind = _KINDS[int(m.lastgroup[1:])][0]
        if _valid(kind, m.group()):
            found.append((m.start(), m.end(), kind))
            at = m.end()
        m = _ANY.search(text, m.end())
    return found


def entities(kind: str, value: str) -> list[str]:
    """What an identifier stands for, however it is written: itself, and of a mail address also the domain."""
    if kind == "EMAIL":
        return [f"EMAIL {value.lower()}", f"DOMAIN {value.lower().rpartition('@')[2]}"]
    if kind in ("CARD", "PHONE", "SSN", "IBAN"):
        return [f"{kind} {''.join(c for c in value if c.isalnum())}"]
    if kind == "SECRET":
        return [f"SECRET {re.split('[=:]', value, maxsplit=1)[1].strip(chr(32) + chr(9) + chr(34) + chr(39))}"]
    return [f"{kind} {value}"]


def contexts(text: str, window: int = WINDOW) -> list[tuple[list[str], list[str]]]:
    """(entities, neighbours) of each identifier: the nearest ``window`` words on either side in lower case, other identifiers passed over."""
    spans = identifiers(text)
    if not spans:
        return []
    words: list[str] = []
    places: list[int] = []
    at = 0
    for start, end, _ in [*spans, (len(text), len(text), "")]:
        for m in _WORD.finditer(text, at, start):
            words.append(m.group())
            places.append(m.start())
        at = end
    out = []
    for start, end, kind in spans:
        k = bisect(places, start)
        out.append((entities(kind, text[start:end]), [w.lower() for w in words[max(0, k - window) : k + window]]))
    return out


def general(word: str) -> str:
    """The class that a word is generalised to."""
    if word.isdigit():
        return "[NUMBER]"
    if any(c.isdigit() for c in word):
        return "[CODE]"
    return "[NAME]" if word[0].isupper() else "[WORD]"


def sanitised(text: str, terms: Mapping[str, bool]) -> tuple[str, int, int]:
    """(text, identifiers replaced, words generalised or removed); ``terms`` says of a word whether it is to go."""
    spans = identifiers(text)
    if terms and terms.keys().isdisjoint({w.lower() for w in set(_WORD.findall(text))}):
        terms = {}
    if not spans and not terms:
        return text, 0, 0
    hidden = 0

    def word(m: re.Match) -> str:
        nonlocal hidden
        gone = terms.get(m.group().lower())
        if gone is None:
            return m.group()
        hidden += 1
        return "" if gone else general(m.group())

    parts, at = [], 0
    for start, end, kind in [*spans, (len(text), len(text), "")]:
        parts.append(_WORD.sub(word, text[at:start]) if terms else text[at:start])
        if kind:
            parts.append(f"[{kind}]")
        at = end
    return "".join(parts), len(spans), hidden


def _neighbours(window: int):  # noqa: ANN202
    """(entity, term, context) of all identifiers; the empty term stands for the occurrence itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(e, w, " ".join(near)) for t in batch["text"] for own, near in contexts(t, window) for e in own for w in ["", *sorted(set(near))]]
            yield pd.DataFrame(rows, columns=["entity", "term", "context"])

    return run


def _counted(wanted: frozenset[str] | None):  # noqa: ANN202
    """(term, times) of a batch's words, of the ``wanted`` ones or all; the empty term counts every word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: Counter[str] = Counter()
            total = 0
            for text in batch["text"]:
                words = _WORD.findall(text)
                total += len(words)
                counts.update(words)
            lower: Counter[str] = Counter()
            for word, n in counts.items():
                if wanted is None or word.lower() in wanted:
                    lower[word.lower()] += n
            lower[""] = total
            yield pd.DataFrame({"term": list(lower), "times": list(lower.values())}, columns=["term", "times"]).astype({"times": "int64"})

    return run


def _lower_bound(share: Column, contexts: Column) -> Column:
    """The lower end of Wilson's interval for a share seen in some contexts."""
    z2 = Z * Z
    spread = F.lit(Z) * F.sqrt(share * (1 - share) / contexts + F.lit(z2 / 4) / (contexts * contexts))
    return (share + F.lit(z2 / 2) / contexts - spread) / (1 + F.lit(z2) / contexts)


def least_contexts(bits: float) -> int:
    """Different contexts that a word needs for at most ``bits`` to be left open, as its share is 1 at most."""
    share = 2.0**-bits
    return max(1, math.ceil(Z * Z * share / (1 - share) - 1e-9)) if share < 1 else 1 << 31


def disclosing_terms(docs: DataFrame, text_col: str = "text", window: int = WINDOW, generalise: float = GENERALISE, remove: float = REMOVE, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """(term, open_bits, disclosure, removed) of the words that leave at most ``generalise`` bits of some entity open, by the strongest one.

    ``disclosure`` is their mutual information as a share of the entity's information content. Counts of candidate words are
    taken where the texts lie: up to ``broadcast_terms`` candidates go to every worker, beyond that all words are
    counted and joined with them. Pairs of fewer contexts than any could reach the bound with are left out early.
    """
    texts = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null")
    near = texts.mapInPandas(_neighbours(window), "entity string, term string, context string")
    pairs = near.groupBy("entity", "term", F.xxhash64("context").alias("context")).agg(F.count("*").alias("times"))
    pairs = pairs.groupBy("entity", "term").agg(F.count("*").alias("contexts"), F.sum("times").alias("both"))
    pairs = checkpoint(pairs.where((F.col("contexts") >= least_contexts(generalise)) | (F.col("term") == "")))
    wanted = pairs.select("term").distinct()
    few = wanted.count() <= broadcast_terms
    counted = texts.mapInPandas(_counted(frozenset(r["term"] for r in wanted.collect()) if few else None), "term string, times long")
    counted = checkpoint(counted.groupBy("term").agg(F.sum("times").alias("times")).join(wanted.unionAll(docs.sparkSession.sql("SELECT ''")).distinct(), "term", "left_semi"))
    total = (counted.where("term = ''").agg(F.max("times")).first()[0]) or 0
    entities = pairs.where("term = ''").select("entity", F.col("both").alias("own"))
    scored = pairs.where("term <> ''").join(counted, "term").join(entities, "entity")
    # An identifier's own words aren't words of its context, so there are at least as many words as entities.
    content = -F.log2(F.col("own") / F.lit(float(max(total, 1))))
    left = -F.log2(_lower_bound(F.col("both") / F.greatest("times", "both"), F.col("contexts")))
    scored = scored.withColumns({"content": content, "open_bits": left}).where((F.col("content") > 0) & (F.col("open_bits") <= generalise))
    best = scored.groupBy("term").agg(F.min(F.struct("open_bits", (-(F.col("content") - F.col("open_bits")) / F.col("content")).alias("share"))).alias("best"))
    return best.select("term", "best.open_bits", (-F.col("best.share")).alias("disclosure"), (F.col("best.open_bits") <= remove).alias("removed"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _distinct_words(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [] if t is None else sorted({w.lower() for w in set(_WORD.findall(t))}))


def sanitise(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    generalise: float = GENERALISE,
    remove: float = REMOVE,
    broadcast_terms: int = BROADCAST_TERMS,
) -> DataFrame:
    """Rows (doc_id, text, n_identifiers, n_terms): each text without identifiers and disclosing words, and what went.

    A text that has neither is returned exactly as it is.

    Defined cases: a null text stays null with counts of 0, an empty one stays empty; repeated rows are sanitised
    alike, and count as one context; null ids stay; texts of any length are read whole, long unbroken runs in linear time; of
    overlapping identifiers the first by its start counts; a word that several entities are revealed by goes by the strongest; an empty table gives no rows; other columns are ignored.
    """
    terms = checkpoint(disclosing_terms(docs, text_col, window, generalise, remove, broadcast_terms))
    kind = docs.schema[id_col]
    schema = T.StructType([T.StructField("doc_id", kind.dataType), T.StructField("text", T.StringType()), *(T.StructField(c, T.IntegerType()) for c in ("n_identifiers", "n_terms"))])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if terms.count() <= broadcast_terms:
        known = {r["term"]: r["removed"] for r in terms.collect()}
        rows = rows.withColumn("terms", F.lit(None).cast("map<string,boolean>"))
    else:
        known = None
        rows = with_row_id(rows, "row")
        words = rows.select("row", F.explode(_distinct_words("text")).alias("term"))
        own = words.join(terms, "term").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "removed"))).alias("terms"))
        rows = rows.join(own, "row", "left").select("id", "text", "terms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, mine in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                out.append((None, 0, 0) if text is None else sanitised(text, known if known is not None else dict(mine or ())))
            columns = [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    return rows.mapInArrow(run, schema)
