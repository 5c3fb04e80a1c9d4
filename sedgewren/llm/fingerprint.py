"""Document fingerprints by consistent weighted sampling.

A text is a bag of terms: its words (cut at ASCII white space, A-Z lowered), each with the weight 1 + ln(number of occurrences).  For every term and sample k two Gamma(2, 1) variates r, c and a uniform b
come from hashes of the term.  With t = floor(ln(weight) / r + b) the term's key is c / (exp(r * (t - b)) * e^r), and the
term of the least key, with its t, is sample k.  Two texts agree in a sample with a chance equal to the generalised
Jaccard similarity (sum of least weights over sum of largest weights) of their bags.

A fingerprint is a string of ``SAMPLES`` times four hexadecimal digits, a 16-bit hash of each sample, so agreements are
counted up to a chance of 1 in 65,536 too often.  Keys of a (term, count) are computed once and kept by a worker in a
table of at most ``CACHE_ROWS`` rows.

Defined cases: null texts and texts without terms have the empty fingerprint, which is alike (1.0) only to itself;
equal texts have equal fingerprints; repeated rows are kept; extra columns pass through, and columns that have the names
of the results are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedgewren.llm.common import staged, with_columns
from sedgewren.llm.shingles import STEP, scrambled

SAMPLES = 64
CACHE_ROWS, KEPT_ROWS = 80_000, 40_000
#: Terms whose keys are computed at once; small enough for the processor's cache.
STEP_ROWS = 512
#: Rows of a neighbourhood that with_next() sorts in one piece, about.
BUCKET_ROWS = 1000
#: Buckets at most; beyond it they grow, and are sorted with spill.
MOST_BUCKETS = 1 << 16
#: Ids that the buckets' edges are chosen from, about.
EDGE_IDS = 250_000

_K = scrambled(np.arange(1, 4 * SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(4, SAMPLES) | np.uint64(1)
_MIX, _32, _48 = np.uint64(0xD6E8FEB86659FD93), np.uint64(32), np.uint64(48)
_ONE, _NINE = np.uint32(0x3F800000), np.uint32(9)


def _uniforms(hashes: np.ndarray, j: int) -> np.ndarray:
    """Two uniform variates in (0, 1) of each hash and sample, side by side, as 23 bits each of a product hash."""
    bits = hashes[:, None] * _K[j]
    bits ^= bits >> _32
    bits *= _MIX
    bits ^= bits >> _32
    halves = bits.view(np.uint32)
    halves >>= _NINE
    halves |= _ONE
    out = halves.view(np.float32)
    out -= np.float32(1 - 2.0**-24)
    return out


def keys(hashes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log key, t) of each weighted term, for all samples."""
    u = _uniforms(hashes, 0)
    r = np.log(u[:, ::2] * u[:, 1::2])
    np.minimum(r, np.float32(-1e-6), out=r)  # -r is the Gamma variate
    u = _uniforms(hashes, 1)
    c = np.log(-np.log(u[:, ::2] * u[:, 1::2]))
    b = _uniforms(hashes, 2)[:, ::2]
    t = np.floor(b - np.log(weights).astype(np.float32)[:, None] / r)
    b -= t
    b -= np.float32(1)
    b *= r  # -r * (1 + t - b)
    c -= b
    return c, t


def marks(hashes: np.ndarray, t: np.ndarray) -> str:
    """16-bit hashes of samples, given by their terms' hashes and t, in hexadecimal."""
    return (scrambled(hashes ^ (_K[3] + t.astype(np.int64).view(np.uint64) * _K[3, 0])) >> _48).astype(">u2").tobytes().hex()


class Sampler:
    """Fingerprints of many texts, with a bounded table of the keys seen."""

    def __init__(self):
        self.rows = _Rows()
        self.key = np.empty((CACHE_ROWS, SAMPLES), np.float32)
        self.t = np.empty((CACHE_ROWS, SAMPLES), np.float32)
        self.hash = np.empty(CACHE_ROWS, np.uint64)

    def fingerprints(self, texts: list[bytes | None]) -> list[str]:
        out = []
        for text in texts:
            hashes, n = terms(text)
            if not len(hashes):
                out.append("")
                continue
            if len(self.rows) + len(hashes) > CACHE_ROWS:
                self.rows.shrink()
            if len(hashes) > CACHE_ROWS - KEPT_ROWS:  # a text of more terms than the table holds
                out.append(_alone(hashes, n))
                continue
            known = len(self.rows)
            at = np.fromiter(map(self.rows.__getitem__, scrambled(hashes ^ (n.astype(np.uint64) * STEP)).tolist()), np.int64, len(hashes))
            new = np.flatnonzero(at >= known)
            for i in range(0, len(new), STEP_ROWS):
                part = new[i : i + STEP_ROWS]
                self.hash[at[part]] = hashes[part]
                self.key[at[part]], self.t[at[part]] = keys(hashes[part], 1 + np.log(n[part]))
            best = at[self.key.take(at, axis=0).argmin(axis=0)]
            out.append(marks(self.hash[best], self.t[best, _AT]))
        return out


def terms(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct words of a text, and how often it has them."""
    bag = Counter((text or b"").lower().split())
    return np.fromiter(map(xxhash.xxh3_64_intdigest, bag), np.uint64, len(bag)), np.fromiter(bag.values(), np.float64, len(bag))


def _alone(hashes: np.ndarray, n: np.ndarray) -> str:
    least, t, own = np.full(SAMPLES, np.inf, np.float32), np.zeros(SAMPLES, np.float32), np.zeros(SAMPLES, np.uint64)
    for i in range(0, len(hashes), STEP_ROWS):
        part = hashes[i : i + STEP_ROWS]
        k, s = keys(part, 1 + np.log(n[i : i + STEP_ROWS]))
        best = k.argmin(axis=0)
        lower = k[best, _AT] < least
        least, t, own = np.where(lower, k[best, _AT], least), np.where(lower, s[best, _AT], t), np.where(lower, part[best], own)
    return marks(own, t)


class _Rows(dict):
    """Rows of the table by term and count; new ones are numbered on."""

    def __missing__(self, x: int) -> int:
        self[x] = n = len(self)
        return n

    def shrink(self) -> None:
        """Keep the rows that came first, which are mostly those of common terms."""
        for x in [x for x, i in self.items() if i >= KEPT_ROWS]:
            del self[x]


_AT = np.arange(SAMPLES)
_SAMPLER: list[Sampler] = []


def fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Append the fingerprint of a text column."""
    if text.lower() == out.lower():
        raise ValueError("the text column and the result column need different names")
    place = [c for c in docs.columns if c.lower() != out.lower()].index(text)

    def f(batch: pa.RecordBatch) -> list[pa.Array]:
        if not _SAMPLER:
            _SAMPLER.append(Sampler())
        texts, found, held, size = batch.column(place).cast(pa.binary()), [], [], 0
        for x in texts:
            held.append(x.as_py())
            size += len(held[-1] or b"")
            if size > 2_000_000:
                found += _SAMPLER[0].fingerprints(held)
                held, size = [], 0
        return [pa.array(found + _SAMPLER[0].fingerprints(held), pa.string())]

    return with_columns(docs, f, [T.StructField(out, T.StringType())])


def likeness(a: str, b: str) -> Column:
    """Share of equal samples of two fingerprint columns: an estimate of their texts' generalised Jaccard similarity."""
    same = F.expr(f"aggregate(sequence(0, {SAMPLES - 1}), 0, (s, i) -> s + int(substring(`{a}`, i * 4 + 1, 4) = substring(`{b}`, i * 4 + 1, 4)))")
    return F.when((F.col(a) == "") | (F.col(b) == ""), (F.col(a) == F.col(b)).cast("double")).otherwise(same / F.lit(float(SAMPLES)))


def _listed(edges: list[str], kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(edges)), "array<string>").cast(f"array<{kind}>")


def _bucket(value: Column, edges: list[str], kind: str) -> Column:
    """How many of the sorted edges are at most the value, by binary search."""
    table = _listed(edges, kind)
    lo, hi = lambda s: s["lo"], lambda s: s["hi"]
    middle = lambda s: F.floor((lo(s) + hi(s)) / 2).cast("int")

    def step(s, _):
        right = F.get(table, middle(s)) <= value
        return F.when(lo(s) < hi(s), F.struct(F.when(right, middle(s) + 1).otherwise(lo(s)).alias("lo"), F.when(right, hi(s)).otherwise(middle(s)).alias("hi"))).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(edges).bit_length() + 1)), F.struct(F.lit(0).alias("lo"), F.lit(len(edges)).alias("hi")), step, lambda s: s["lo"])


def _own(docs: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def with_next(docs: DataFrame, ids: DataFrame, columns: list[str], doc_id: str = "doc_id") -> DataFrame:
    """Append next_<column>: what the row of the next larger id holds there; the last row gets the first one's.

    ``ids`` has the id column of the same rows, read without the others. Ids of any ordered type are cut into ranges of about
    ``BUCKET_ROWS`` rows at edges drawn from the ids themselves, so outliers and gaps do not matter; the row at a range's edge is
    copied to the range before, so rows move once and no task sorts more than a range. Equal ids stand in the order of a hash of
    their columns, and are sorted in one task, with spill. A row with a null id has no place in the order: its next row is the first one. Without any id, next is null.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    key, n, nulls = F.col(doc_id), *ids.agg(F.count("*"), F.count(F.when(F.col(doc_id).isNull(), 1))).first()
    sample = ids.where(key.isNotNull() & (F.pmod(F.xxhash64(key), F.lit(max(1, n // EDGE_IDS))) == 0)).unionByName(ids.agg(F.min(doc_id).alias(doc_id)).where(key.isNotNull()))
    sample = [r[0] for r in sample.distinct().orderBy(key).select(key.cast("string")).collect()]
    if not sample:
        return docs.select("*", *(F.lit(None).cast(docs.schema[c].dataType).alias(f"next_{c}") for c in columns))
    buckets = min(MOST_BUCKETS, -(-n // BUCKET_ROWS), len(sample))
    edges = [sample[len(sample) * i // buckets] for i in range(buckets)]
    spread = max(1, -(-nulls // BUCKET_ROWS))  # ranges of the rows without an id, behind the others
    at, copy, tie, to = (_own(docs, c) for c in ("bucket_", "copy_", "tie_", "to_"))
    placed = docs.withColumn(tie, F.xxhash64(*columns)).withColumn(at, F.when(key.isNull(), buckets + F.pmod(F.col(tie), F.lit(spread))).otherwise(_bucket(key, edges, kind) - 1).cast("int"))
    is_edge = F.get(_listed(edges, kind), F.col(at)) == key
    names = [F.col(f"`{c}`") for c in docs.columns]
    on_edge = F.get(_listed(edges, kind), _bucket(key, edges, kind) - 1) == key
    repeated = ids.where(on_edge).groupBy(key).count().where("count > 1").count()
    if repeated:  # only one of the rows of an edge's id is copied
        placed = staged(placed, "placed")
        first = placed.where(is_edge).groupBy(at).agg(F.min_by(F.struct(*names, tie), F.col(tie)).alias(to)).select(F.col(f"{to}.*"), at)
        placed = placed.withColumn(copy, F.lit(0)).unionByName(first.withColumn(copy, F.lit(1)))
        is_edge = F.col(copy) == 1
    before = F.pmod(F.col(at) - 1, F.lit(buckets))
    heads = F.when(F.coalesce(is_edge, F.lit(False)), F.array(before)).otherwise(F.array().cast("array<int>"))
    if nulls:
        heads = F.when((F.col(at) == 0) & F.coalesce(is_edge, F.lit(False)), F.concat(heads, F.sequence(F.lit(buckets), F.lit(buckets + spread - 1)))).otherwise(heads)
    copies = F.transform(heads, lambda b: F.struct(b.alias("b"), F.lit(1).alias("c")))
    targets = F.concat(F.array(F.struct(F.col(at).alias("b"), F.lit(0).alias("c"))), copies)
    if repeated:
        targets = F.when(is_edge, copies).otherwise(F.array(F.struct(F.col(at).alias("b"), F.lit(0).alias("c"))))
    dealt = placed.select(*names, tie, F.explode(targets).alias(to)).select(*names, F.col(f"{to}.b").alias(at), F.col(f"{to}.c").alias(copy), tie)
    order = Window.partitionBy(at).orderBy(copy, key.asc_nulls_last(), tie)
    led = {c: F.lead(c).over(order) for c in columns}
    if nulls:
        head = Window.partitionBy(at).orderBy(F.desc(copy), tie)
        led = {c: F.when(key.isNull(), F.first(c).over(head)).otherwise(x) for c, x in led.items()}
    out = dealt.select(*names, copy, *(x.alias(f"next_{c}") for c, x in led.items()))
    return out.where(F.col(copy) == 0).drop(copy)
