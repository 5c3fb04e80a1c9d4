"""Alignment of the tokens of two tokenizers over the same bytes.

A is a byte-level BPE (its file is JSON), B a piece model with byte fallback.  Both encode the same bytes: A a space and the
text, B the text, before which it puts that space itself.  The texts of a piece of an Arrow batch are laid end to end; one
bincount of the ends of A's tokens and one of B's over all bytes give, by prefix sums, the number of tokens that end at or
before any offset.  Where both count, a group is cut.  Sums at the documents' own edges, taken from each other, give what
belongs to each document, so no document is handled by itself.  Every stretch between two neighbouring ends of A or B lies in
one token of each: these are the links.

The distinct links of a document go on as two short arrays (id pairs, and how often each occurs).  Documents that hold a
pair are counted over the whole corpus by a partial aggregation in each task.  Counts are brought back to the documents' links
by a broadcast of the most frequent pairs, at most ``SENT`` of them; rarer pairs, if any are left, meet by a shuffle, which
then has no hot key.

Defined cases: null and empty texts, and texts that a tokenizer doesn't give back byte for byte (such as those that hold U+2581,
which B reads as a space), have no tokens: zeros and empty groups.  Strings of special tokens in a text are plain text.  Equal
texts and repeated rows get equal results, and each of them counts as a document.  Very long texts are read whole; B gets them
in stretches that end before a space, which gives the same tokens as no piece has a space inside; the vocabulary is asked whether
that holds.  Ties for the highest count are all best.  An empty table gives an empty table.  Other columns pass through, and columns
that have the names of the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedgewren.llm import bpe
from sedgewren.llm.common import in_small_batches, staged

#: Bytes of text, about, that are aligned at once.
PIECE = 1 << 20
#: Characters from which a text is cut for B.
STRETCH = 1 << 16
#: Id pairs whose counts are broadcast (16 bytes each); the others are joined by a shuffle.
SENT = 2_000_000
SPACE = "▁"


class Tokenizers:
    """Both tokenizers of a worker, with the bytes and lengths of their tokens."""

    def __init__(self, a: str, b: bytes):
        import sentencepiece

        self.codec, self.pieces = bpe.Codec(a), sentencepiece.SentencePieceProcessor(model_proto=b)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        self.a_bytes = self.codec.bytes_of
        self.b_bytes = [bytes([int(s[3:-1], 16)]) if self.pieces.is_byte(i) else s.replace(SPACE, " ").encode() for i, s in enumerate(names)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in v], np.int64) for v in (self.a_bytes, self.b_bytes))
        self.cuttable = not any(SPACE in s.lstrip(SPACE) for s in names)
        #: each id as text with the sign that follows it: inside a side of a group, or at its end
        self.shown = [f"{i}{end}" for i in range(len(self.a_bytes)) for end in ",|"] + [f"{i}{end}" for i in range(len(names)) for end in ",;"]

    def stretches(self, text: str) -> list[str]:
        """The text in stretches that each begin at a space after another sign; the space itself is what B puts before a text."""
        out, at = [], 0
        while self.cuttable and len(text) - at > STRETCH:
            cut = text.find(" ", at + STRETCH)
            while cut > 0 and text[cut - 1] in (" ", SPACE):
                cut = text.find(" ", cut + 1)
            if cut < 0:
                break
            out.append(text[at:cut])
            at = cut + 1
        return [*out, text[at:]]

    def encoded(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], list[int]]:
        """Ids of A and B and the bytes of each text; none where a tokenizer doesn't give the text back."""
        parts = [self.stretches(t) if t else [] for t in texts]
        flat = iter(self.pieces.encode([p for ps in parts for p in ps], num_threads=1))
        a_ids, b_ids, sizes = [], [], []
        for text, ps, a in zip(texts, parts, self.codec.plain([" " + t if t else "" for t in texts])):
            b = [i for _ in ps for i in next(flat)]
            a = np.frombuffer(a, "<u4")
            whole = b" " + text.encode() if text else b""
            # A's words are cut from the text and its merges keep their bytes, so its length tells
            if self.a_sizes[a].sum() != len(whole) or b"".join(map(self.b_bytes.__getitem__, b)) != whole:
                a, b, whole = a[:0], [], b""
            a_ids.append(a)
            b_ids.append(np.array(b, np.int64))
            sizes.append(len(whole))
        return a_ids, b_ids, sizes


def aligned(a: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_sizes: np.ndarray, doc_ends: np.ndarray) -> dict[str, np.ndarray]:
    """Groups and links of documents that lie end to end and end at ``doc_ends``; ``a`` and ``b`` are the ids of all their tokens.

    ``n_groups`` and ``n_links`` are of each document; ``order`` puts the tokens of A, then those of B, of every group in their
    places; ``a_last`` and ``b_last`` mark the last token of a side; ``link_a``, ``link_b`` are token numbers and ``link_doc`` the document.
    """
    total = int(doc_ends[-1]) if len(doc_ends) else 0
    a_ends, b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
    at_a, at_b = np.bincount(a_ends, minlength=total + 1), np.bincount(b_ends, minlength=total + 1)
    both = (at_a > 0) & (at_b > 0)
    cuts = np.flatnonzero(both)
    a_until, b_until, cuts_until = np.cumsum(at_a, dtype=np.int32), np.cumsum(at_b, dtype=np.int32), np.cumsum(both, dtype=np.int32)
    edges = np.concatenate(([0], doc_ends))
    begins = np.concatenate(([0], cuts))
    a_group, b_group = cuts_until[a_ends - a_sizes], cuts_until[b_ends - b_sizes]
    order = np.concatenate((np.arange(len(a)) + b_until[begins[a_group]], np.arange(len(b)) + a_until[begins[b_group + 1]])) if len(a) else np.zeros(0, np.int64)
    ends = np.flatnonzero(at_a + at_b)
    any_until = np.cumsum((at_a + at_b) > 0, dtype=np.int32)
    return {
        "n_groups": np.diff(cuts_until[edges]), "n_links": np.diff(any_until[edges]), "order": order, "a_last": both[a_ends], "b_last": both[b_ends],
        "link_a": a_until[ends - 1], "link_b": b_until[ends - 1], "link_doc": np.searchsorted(doc_ends, ends, "left"),
    }


def _listed(owner: np.ndarray, n: int, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Values of owners 0 to n - 1, in their order, as a list array."""
    offsets = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _of_texts(known: Tokenizers, texts: list[str]) -> list[pa.Array]:
    a_ids, b_ids, sizes = known.encoded(texts)
    n_a, n_b = np.array([len(x) for x in a_ids], np.int64), np.array([len(x) for x in b_ids], np.int64)
    a, b = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (a_ids, b_ids))
    found = aligned(a, known.a_sizes[a], b, known.b_sizes[b], np.cumsum(np.array(sizes, np.int64)))
    signs = np.empty(len(a) + len(b), np.int64)
    signs[found["order"]] = np.concatenate((2 * a + found["a_last"], 2 * (len(known.a_sizes) + b) + found["b_last"]))
    shown, until = list(map(known.shown.__getitem__, signs.tolist())), np.concatenate(([0], np.cumsum(n_a + n_b))).tolist()
    groups = ["".join(shown[i:j])[:-1] for i, j in zip(until, until[1:])]
    pairs = len(known.a_sizes) * len(known.b_sizes)
    link = found["link_doc"] * pairs + a[found["link_a"]] * len(known.b_sizes) + b[found["link_b"]]
    distinct, times = np.unique(link, return_counts=True)
    owner = distinct // pairs
    return [
        pa.array(n_a), pa.array(n_b), pa.array(found["n_groups"], pa.int64()), pa.array(found["n_links"], pa.int64()), pa.array(groups, pa.string()),
        _listed(owner, len(texts), distinct % pairs, pa.int64()), _listed(owner, len(texts), times, pa.int32()),
    ]


FIELDS = [
    *(T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")), T.StructField("groups", T.StringType()),
    T.StructField("link_pairs", T.ArrayType(T.LongType())), T.StructField("link_times", T.ArrayType(T.IntegerType())),
]

_KNOWN: dict[int, Tokenizers] = {}


def _known(shared) -> Tokenizers:
    key = hash(shared.value)
    if key not in _KNOWN:
        _KNOWN[key] = Tokenizers(*shared.value)
    return _KNOWN[key]


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """Append n_a, n_b, n_groups, n_links, groups (``a1,a2|b1;a3|b2``), link_pairs and link_times of each text.

    A pair is A's id times B's vocabulary plus B's id; see pair_ids().
    """
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        shared = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))  # two files of fixed size
    new = {f.name for f in FIELDS}
    if text.lower() in new:
        raise ValueError("the text column and the result columns need different names")
    kept = docs.select([F.col(f"`{c}`") for c in docs.columns if c.lower() not in new])
    place, names = kept.columns.index(text), [*kept.columns, *(f.name for f in FIELDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(shared)
        for batch in batches:
            step = max(1, batch.num_rows * PIECE // max(1, batch.nbytes))
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                yield pa.RecordBatch.from_arrays([*part.columns, *_of_texts(known, [x or "" for x in part.column(place).to_pylist()])], names=names)

    return in_small_batches(kept).mapInArrow(run, T.StructType([*kept.schema.fields, *FIELDS]))


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, documents: how many rows hold each id pair linked."""
    return rows.select(F.explode("link_pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("documents"))


def with_best(counts: DataFrame, b_ids: int) -> DataFrame:
    """Counts with best: whether no pair of the same A id has more documents. An A id has ``b_ids`` pairs at most."""
    a = F.floor(F.col("pair") / b_ids)
    most = counts.groupBy(a.alias("a")).agg(F.max("documents").alias("most"))
    return counts.withColumn("a", a).join(most, "a").select("pair", "documents", (F.col("documents") == F.col("most")).alias("best"))


def pair_ids(counts: DataFrame, b_ids: int) -> DataFrame:
    """The pair as a_id and b_id: with the best ones alone, a table from one vocabulary to the other."""
    return counts.select(F.floor(F.col("pair") / b_ids).alias("a_id"), (F.col("pair") % b_ids).alias("b_id"), *[c for c in counts.columns if c != "pair"])


def with_counts(rows: DataFrame, counts: DataFrame, sent: int = SENT) -> DataFrame:
    """Append n_best and count_sum to aligned rows, which must be a staged table, as must ``counts`` (see with_best()).

    The results are long: links whose pair is a best one of its A id, and the sum of documents over all links.
    """
    rows = rows.select([F.col(f"`{c}`") for c in rows.columns if c.lower() not in ("n_best", "count_sum")])
    row = next(c for c in (f"_row{i}" for i in range(len(rows.columns) + 1)) if c not in {x.lower() for x in rows.columns})
    rows = rows.withColumn(row, F.monotonically_increasing_id())  # of files that are written, so the same each time
    links = rows.select(row, F.explode(F.arrays_zip("link_pairs", "link_times")).alias("l")).select(row, F.col("l.link_pairs").alias("pair"), F.col("l.link_times").alias("times"))
    n = counts.count()
    least = counts.agg(F.percentile_approx("documents", 1 - sent / n, 10_000)).first()[0] if n > sent else 0
    frequent = F.broadcast(counts.where(F.col("documents") > least))  # at most ``sent`` rows, up to the estimate's error
    met = links.join(frequent, "pair", "left")
    seen = met.where("documents is not null")
    if n > sent:
        rest = met.where("documents is null").select(row, "pair", "times").join(counts.where(F.col("documents") <= least), "pair")
        seen = seen.unionByName(rest)
    sums = seen.groupBy(row).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("documents")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.join(sums, row, "left").select(*[F.col(f"`{c}`") for c in rows.columns if c != row], zero("n_best"), zero("count_sum"))


def b_vocabulary(b_path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()


def cross_counts(rows: DataFrame, b_path: str) -> DataFrame:
    """All of it over a staged table of aligned rows: their pairs counted over the corpus and brought back to each row."""
    counts = staged(pair_counts(rows), "pairs")
    return with_counts(rows, staged(with_best(counts, b_vocabulary(b_path)), "pair-counts"))
