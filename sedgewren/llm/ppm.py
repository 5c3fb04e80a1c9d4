"""Language-model scores by prediction by partial matching.

A text is the sequence of its words, A-Z lowered, a blank between them, and an end sign.  Every byte is coded in the context
of the ``ORDER`` bytes before it, blanks and the ends of earlier words included (a text begins in a context of end signs).
The model is the trie of all byte contexts of the training texts, of every length up to ``ORDER``, with all their counts.  A
symbol is coded in the longest context that the trie has, with count / (total + once + 1), ``once`` being the number of symbols
seen there once.  What remains is the escape, after which the next shorter context is asked, where all symbols that longer
contexts offered are excluded; below the empty context all remaining symbols are equally likely.

Above these stand long contexts, as an unbounded trie has them, with edges of many bytes.  A text is cut into phrases behind
words whose hash is divisible by ``PHRASE``, so equal passages have equal phrases.  A phrase (with the blank or end sign behind
it) that followed the same phrase in training n of N times is coded by one edge, with n / (N + 1); otherwise 1 / (N + 1) is paid
if N > 0, and its bytes are coded as above.  A text's first phrase follows the beginning of texts, which hardly ever recurs with
the same phrase: there an edge has n / 2N, and 1 / 2 is paid without one.

Nothing is capped, and no task holds the trie.  Texts are packed into blocks of about ``BLOCK`` bytes.  A block's distinct
windows (a symbol and the ``ORDER`` bytes before it) and distinct words and phrases are asked for once: windows are summed in
buckets of their hash, then dealt by the last ``SUFFIX`` bytes of the context, so that each longer context is whole in one
task, which computes the code lengths; shorter contexts are counted for all (at most 256 ** ``SUFFIX`` counts).  The
answers go back to the blocks by the same buckets.  A frequent context is one key for each block at most, and one in all after
the first sum; the number of buckets follows the size of the texts.

Defined cases: null text is the empty text and has the end sign alone; a row with a null id counts as not held out; repeated
rows are texts of their own; without training rows every count is 0, every symbol is equally likely and the base score is
n * log10(0.5 / 0.5) = 0; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgewren.llm.common import freed, in_small_batches, staged
from sedgewren.llm.shingles import STEP, scrambled

ORDER, SUFFIX = 6, 3
#: One word in so many ends a phrase.
PHRASE = 16
#: Bytes of texts in a block; less where the texts give fewer than ``BLOCKS`` blocks, down to PIECE, the bytes whose windows are
#: formed at once.
BLOCK, BLOCKS, PIECE = 32 << 20, 8, 2 << 20
#: Bytes of texts for each bucket, and the least and largest number of buckets; beyond it buckets grow (at 100 TB, to some 60
#: million phrases each), as a block's keys would come in ever smaller rows.
BUCKET_BYTES, BUCKETS, MOST_BUCKETS = 64 << 20, 16, 65_536
#: Tasks of a shuffle at most.
TASKS = 20_000
#: Bytes that are no ASCII white space, the blank between words, and the end sign.
SYMBOLS = 256 - 6 + 2
END = b"\n"
#: Kinds of rows; those of a block's texts come last.
WINDOWS, WORDS, PHRASES, TEXTS = range(4)
_8, _16 = np.uint64(8), np.uint64(16)
_LAST = np.uint64(255)


def held_out(doc_id: str = "doc_id", parts: int = 5, at: int = 1) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == at, F.lit(False))


def spelled(text: bytes | None) -> bytes:
    """The symbols of a text."""
    return b" ".join((text or b"").lower().split()) + END


def tokens(streams: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of some texts, and how many each text has."""
    words = [s.split() for s in streams]
    for w in words:
        w.append(END)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), np.uint64, int(sizes.sum())), sizes


def windows(streams: list[bytes]) -> np.ndarray:
    """The window of each symbol: the bytes before it, the nearest first, and the symbol, as one integer."""
    flat = np.frombuffer(b"".join(END * ORDER + s for s in streams), np.uint8)
    key = flat[ORDER:].astype(np.uint64)
    for j in range(1, ORDER + 1):
        key |= flat[ORDER - j : len(flat) - j].astype(np.uint64) << np.uint64(8 * (ORDER + 1 - j))
    begins = np.cumsum([len(s) + ORDER for s in streams])[:-1]
    keep = np.ones(len(key), bool)
    keep[(begins[:, None] - np.arange(1, ORDER + 1)).ravel()] = False
    return key[keep]


def phrases(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The phrases of some texts: their first tokens, each text's first phrase, and the keys of their contexts and of themselves there."""
    begins = np.cumsum(sizes) - sizes
    cut = np.zeros(len(hashes), bool)
    cut[1:] = hashes[:-1] % np.uint64(PHRASE) == 0
    cut[begins + sizes - 1] = False  # the end sign ends the last phrase
    cut[begins] = True
    first = np.flatnonzero(cut)
    place = (np.arange(len(hashes)) - np.repeat(first, np.diff(np.append(first, len(hashes))))).astype(np.uint64)
    phrase = scrambled(np.add.reduceat(scrambled(hashes ^ (place * STEP)), first))
    texts = np.searchsorted(first, begins)
    before = np.zeros(len(phrase), np.uint64)  # the beginning of texts
    before[1:] = phrase[:-1]
    before[texts] = 0
    context = scrambled(before + np.uint64(1))
    return first, texts, context, scrambled(context ^ (phrase * STEP))


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    if not len(keys):
        return keys, n
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(n[order], first)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys.sort()
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.r_[first, len(keys)])


def packed(x: np.ndarray, ascending: bool = False) -> bytes:
    """An array of 8-byte numbers, compressed; ascending keys by their differences."""
    x = np.ascontiguousarray(x).view(np.uint64)
    if ascending and len(x):
        x = np.r_[x[:1], x[1:] - x[:-1]]
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpacked(data: bytes, kind: type, ascending: bool = False) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(data), np.uint8)
    x = np.ascontiguousarray(flat.reshape(8, -1).T).view(np.uint64)[:, 0] if len(flat) else np.zeros(0, np.uint64)
    return np.cumsum(x, dtype=np.uint64) if ascending else x.view(kind)


def packed_values(x: np.ndarray) -> bytes:
    """Numbers of which many are equal: the distinct ones, and where they stand."""
    values, place = np.unique(x, return_inverse=True)
    head = packed(values)
    return len(head).to_bytes(8, "little") + head + packed(place.astype(np.int64))


def unpacked_values(data: bytes) -> np.ndarray:
    end = 8 + int.from_bytes(data[:8], "little")
    return unpacked(data[8:end], np.float64)[unpacked(data[end:], np.int64)]


def shorter(grams: np.ndarray) -> np.ndarray:
    """Grams (context, symbol) with the farthest byte of the context left out."""
    return (grams >> _16 << _8) | (grams & _LAST)


class _Level:
    """The contexts of one length, with their symbols' counts."""

    def __init__(self, grams: np.ndarray, n: np.ndarray):
        self.grams, self.n = grams, n
        contexts = grams >> _8
        self.first = np.flatnonzero(np.r_[True, contexts[1:] != contexts[:-1]]) if len(grams) else np.zeros(0, np.int64)
        self.contexts = contexts[self.first]
        self.kinds = np.diff(np.r_[self.first, len(grams)])
        self.total, self.once = self._sums(n), self._sums((n == 1).astype(np.int64))
        all_of = self.total + self.once + 1.0
        self.size, self.escape = np.log10(all_of), np.log10((self.once + 1) / all_of)

    def _sums(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, self.first) if len(self.first) else x

    def step_to(self, below: _Level) -> None:
        """What remains of each context's next shorter one without the symbols of this one."""
        m = below.n[np.searchsorted(below.grams, shorter(self.grams))]
        up = np.searchsorted(below.contexts, self.contexts >> _8)
        once = below.once[up] - self._sums((m == 1).astype(np.int64))
        rest = below.total[up] - self._sums(m) + once + 1.0
        self.next_size = np.log10(rest)
        self.next_escape = np.where(self.kinds == below.kinds[up], 0.0, np.log10((once + 1) / rest))


def code_lengths(keys: np.ndarray, n: np.ndarray, low: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 of the probability of the symbol of each window.

    ``keys`` are distinct windows with their counts in training (0 for those that are only asked for); they hold every training
    window of their contexts of ``SUFFIX`` and more bytes. ``low``: sorted grams of ``SUFFIX`` - 1 context bytes, and counts.
    """
    levels: list[_Level] = [None] * (ORDER + 1)
    seen = n > 0
    grams, counts = keys[seen], n[seen]
    for k in range(ORDER, SUFFIX - 1, -1):
        grams, counts = summed(grams, counts)
        levels[k] = _Level(grams, counts)
        grams = shorter(grams)
    grams, counts = low
    for k in range(SUFFIX - 1, -1, -1):
        grams, counts = summed(grams, counts)
        levels[k] = _Level(grams, counts)
        grams = shorter(grams)
    for k in range(ORDER, 0, -1):
        levels[k].step_to(levels[k - 1])
    out = np.zeros(len(keys))
    left, gram = np.arange(len(keys)), keys
    size = escape = np.full(len(keys), np.nan)
    for k in range(ORDER, -1, -1):
        level = levels[k]
        if len(level.contexts):
            at = np.minimum(np.searchsorted(level.contexts, gram >> _8), len(level.contexts) - 1)
            known = level.contexts[at] == gram >> _8
            size, escape = np.where(known & np.isnan(size), level.size[at], size), np.where(known & np.isnan(escape), level.escape[at], escape)
            place = np.minimum(np.searchsorted(level.grams, gram), len(level.grams) - 1)
            found = level.grams[place] == gram
            out[left[found]] += np.log10(level.n[place[found]]) - size[found]
            out[left[known & ~found]] += escape[known & ~found]
            if k:
                size, escape = np.where(known, level.next_size[at], np.nan), np.where(known, level.next_escape[at], np.nan)
            left, gram, size, escape = left[~found], gram[~found], size[~found], escape[~found]
        gram = shorter(gram) if k else gram
    out[left] -= np.log10(SYMBOLS - (levels[0].kinds[0] if len(levels[0].kinds) else 0))
    return out


class _Sums:
    """Sums of counts by key, merged now and then, so that memory follows the distinct keys."""

    def __init__(self):
        self.parts, self.merged, self.open = [], 0, 0

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((keys, n))
        self.open += len(keys)
        if self.open > max(1 << 20, self.merged // 2):
            self.result()

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) > 1:
            self.parts = [summed(np.concatenate([k for k, _ in self.parts]), np.concatenate([n for _, n in self.parts]))]
        self.merged, self.open = len(self.parts[0][0]), 0
        return self.parts[0]


class _Block:
    """Texts that are packed together, and the counts of their distinct keys in training."""

    def __init__(self):
        self.ids, self.held, self.size, self.tokens = [], [], 0, 0
        self.sizes: list[int] = []
        self.packer = zstandard.ZstdCompressor(6).compressobj()
        self.packed: list[bytes] = []
        self.open: tuple[list, list] = ([], [])
        self.open_size = 0
        self.found = {WINDOWS: _Sums(), WORDS: _Sums(), PHRASES: _Sums()}

    def add(self, doc_id, held: bool, text: bytes | None) -> None:
        stream = spelled(text)
        self.ids.append(doc_id)
        self.held.append(held)
        self.sizes.append(len(stream))
        self.packed.append(self.packer.compress(stream))
        self.size += len(stream)
        self.open[held].append(stream)
        self.open_size += len(stream)
        if self.open_size > PIECE:
            self.count()

    def count(self) -> None:
        for held, streams in enumerate(self.open):
            if streams:
                hashes, sizes = tokens(streams)
                self.tokens += 0 if held else len(hashes)
                for kind, keys in ((PHRASES, np.concatenate(phrases(hashes, sizes)[2:])), (WORDS, hashes), (WINDOWS, windows(streams))):
                    keys, n = _counted(keys)
                    self.found[kind].add(keys, n * (not held))
        self.open, self.open_size = ([], []), 0

    def texts(self) -> bytes:
        return b"".join([*self.packed, self.packer.flush()])


_COLUMNS = "block long, bucket int, kind int, keys binary, n binary, low_grams array<int>, low_counts array<long>, held array<boolean>, sizes array<long>, tokens long, texts binary"
def _packed_blocks(docs: DataFrame, buckets: int, full: int) -> DataFrame:
    """Rows of blocks: their texts, and their keys by bucket."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows_of(block: _Block, number: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        block.count()
        for what in (WINDOWS, WORDS, PHRASES):
            keys, n = block.found[what].result()
            bucket = (scrambled(keys) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(edges)).tolist():
                at = order[edges[b] : edges[b + 1]]
                yield made(number, b, what, packed(keys[at], True), packed(n[at]), id_type=id_type)
            if what == WINDOWS:
                grams, counts = keys[n > 0], n[n > 0]
                for _ in range(ORDER - SUFFIX + 1):
                    grams = shorter(grams)
                grams, counts = summed(grams, counts)
        yield made(number, None, TEXTS, None, None, grams.astype(np.int32), counts, block.ids, block.held, block.sizes, block.tokens, block.texts(), id_type)

    def made(block, bucket, what, keys, n, grams=None, counts=None, ids=None, held=None, sizes=None, tokens=None, texts=None, id_type=None) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.list_(id_type)]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((block, bucket, what, keys, n, grams, counts, held, sizes, tokens, texts, ids), kinds)], names=names)

    names = [*(x.split()[0] for x in _COLUMNS.split(", ")), "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, block, id_type = TaskContext.get().partitionId() << 32, _Block(), pa.null()
        for batch in batches:
            id_type = batch.column(0).type
            for i, text, held in zip(batch.column(0), batch.column(1).cast(pa.binary()), batch.column(2)):
                block.add(i.as_py(), held.as_py(), text.as_py())
                if block.size >= full:
                    yield from rows_of(block, number, id_type)
                    number, block = number + 1, _Block()
        if block.ids:
            yield from rows_of(block, number, id_type)

    return in_small_batches(docs).mapInArrow(run, f"{_COLUMNS}, ids array<{kind}>")


def _grouped(rows: DataFrame, tasks: int, by: str, then: str, f: Callable, schema: str) -> DataFrame:
    """Apply ``f(value, iterator of rows)`` to the rows of each value of ``by``, in the order of ``then``; ``f`` yields tuples."""
    names = rows.columns
    dealt = rows.repartition(min(tasks, TASKS), by).sortWithinPartitions(by, then)
    fields = [x.strip().split()[0] for x in schema.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    kinds = [types[x.strip().split()[1]] for x in schema.split(", ")]

    def run(batches):
        def each():
            for batch in batches:
                for row in zip(*batch.columns):
                    yield dict(zip(names, (x.as_py() for x in row)))

        for value, group in groupby(each(), key=lambda r: r[by]):
            for out in f(value, group):
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(out, kinds)], names=fields)

    return dealt.mapInArrow(run, schema)


def _window_answers(asked: DataFrame, low: tuple[np.ndarray, np.ndarray], buckets: int) -> DataFrame:
    """(block, kind, keys, answer) of (block, bucket, keys, n): the code lengths of the windows of each block."""
    spark = asked.sparkSession
    shared = spark.sparkContext.broadcast(low)  # at most 256 ** SUFFIX counts

    def sums(bucket, rows):
        sums = _Sums()
        for r in rows:
            sums.add(unpacked(r["keys"], np.uint64, True), unpacked(r["n"], np.int64))
        keys, n = sums.result()
        to = (scrambled(keys >> np.uint64(8 * (ORDER + 1 - SUFFIX))) % np.uint64(buckets)).astype(np.int64)
        for t in np.unique(to).tolist():
            yield t, bucket, packed(keys[to == t], True), packed(n[to == t])

    def costs(_, rows):
        sums, whose = _Sums(), []
        for r in rows:
            whose.append((r["bucket"], r["keys"]))
            sums.add(unpacked(r["keys"], np.uint64, True), unpacked(r["n"], np.int64))
        keys, n = sums.result()
        cost = code_lengths(keys, n, shared.value)
        for bucket, k in whose:
            yield bucket, None, k, packed_values(cost[np.searchsorted(keys, unpacked(k, np.uint64, True))])

    def answers(_, rows):
        keys, cost, known = [], [], None
        for r in rows:
            k = unpacked(r["keys"], np.uint64, True)
            if r["block"] is None:
                keys.append(k)
                cost.append(unpacked_values(r["n"]))
                continue
            if known is None:
                known, cost = np.concatenate(keys), np.concatenate(cost)
                order = np.argsort(known)
                known, cost = known[order], cost[order]
            yield r["block"], WINDOWS, r["keys"], packed_values(cost[np.searchsorted(known, k)])

    distinct = _grouped(asked.select("bucket", "block", "keys", "n"), buckets, "bucket", "block", sums, "to int, bucket int, keys binary, n binary")
    priced = _grouped(distinct, buckets, "to", "bucket", costs, "bucket int, block long, keys binary, n binary")
    both = priced.unionByName(asked.select("bucket", "block", "keys", F.lit(None).cast("binary").alias("n")))
    return _grouped(both, buckets, "bucket", "block", answers, "block long, kind int, keys binary, answer binary")  # nulls first


def _hash_answers(asked: DataFrame, buckets: int) -> DataFrame:
    """(block, kind, bucket, answer, types): how often the training texts have the words and phrases of each block, in their order.

    One row of each bucket and kind has no block, and the number of keys that training has.
    """

    def answers(bucket, rows):
        sums, whose = {}, []
        for r in rows:
            whose.append((r["block"], r["kind"], r["keys"]))
            sums.setdefault(r["kind"], _Sums()).add(unpacked(r["keys"], np.uint64, True), unpacked(r["n"], np.int64))
        for kind, x in sums.items():
            keys, n = x.result()
            yield None, kind, bucket, None, int((n > 0).sum())
            for block, own, k in whose:
                if own == kind:
                    yield block, kind, bucket, packed(n[np.searchsorted(keys, unpacked(k, np.uint64, True))]), None

    return _grouped(asked.select("bucket", "block", "kind", "keys", "n"), buckets, "bucket", "block", answers, "block long, kind int, bucket int, answer binary, types long")


def _lengths(streams: list[bytes], keys: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """The code lengths of all bytes of some texts."""
    own = windows(streams)
    order = np.argsort(own)
    own = own[order]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    out = np.empty(len(own))
    out[order] = np.repeat(cost[np.searchsorted(keys, own[first])], np.diff(np.append(first, len(own))))
    return out


def _text_scores(streams: list[bytes], hashes: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, count: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """log10 of the probability of each text from the code lengths of its bytes, and the counts of its phrases and their contexts."""
    first, texts, context, node = phrases(hashes, sizes)
    total, n = count(context), count(node)
    # a token begins behind a blank or an end sign, but the end sign of a text with words
    starts = np.ones(len(hashes), bool)
    starts[(np.cumsum(sizes) - 1)[sizes > 1]] = False
    at = np.zeros(len(hashes), np.int64)
    flat = np.frombuffer(b"".join(streams), np.uint8)
    at[starts] = np.append(0, np.flatnonzero((flat[:-1] == 0x20) | (flat[:-1] == END[0])) + 1)
    own = np.add.reduceat(lengths, at[first])
    edge = np.where(n > 0, np.log10(np.maximum(n, 1) / (total + 1.0)), own - np.log10(total + 1.0))
    if len(texts) and total[texts[0]]:
        edge[texts] = np.where(n[texts] > 0, np.log10(np.maximum(n[texts], 1) / (2.0 * total[texts])), own[texts] - np.log10(2))
    return np.add.reduceat(edge, texts)


def _table(keys: np.ndarray, buckets: int, answers: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of a block with their answers, which come by bucket."""
    keys, _ = _counted(keys)
    order = np.argsort((scrambled(keys) % np.uint64(buckets)).astype(np.int64), kind="stable")
    values = np.concatenate([x for _, x in sorted(answers, key=lambda a: a[0])])
    out = np.empty(len(keys), values.dtype)
    out[order] = values
    return keys, out


def score(docs: DataFrame, held: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each row of ``docs``.

    The model learns from the rows that are not held out and scores all.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text", (held if held is not None else held_out()).alias("held_out"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = min(max(BUCKETS, -(-size // BUCKET_BYTES)), MOST_BUCKETS)
    blocks = staged(_packed_blocks(docs, buckets, max(min(BLOCK, PIECE), min(BLOCK, size // BLOCKS))), "ppm-blocks", "kind")
    texts = blocks.where(F.col("kind") == TEXTS)
    train_tokens, n_blocks = texts.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    pairs = texts.select(F.explode(F.arrays_zip("low_grams", "low_counts")).alias("x")).groupBy("x.low_grams").agg(F.sum("x.low_counts").alias("n")).toArrow()
    low = summed(pairs.column(0).to_numpy().astype(np.uint64), pairs.column(1).to_numpy().astype(np.int64))
    asked = blocks.where(F.col("kind") == WINDOWS)
    counted = staged(_hash_answers(blocks.where(F.col("kind").isin(WORDS, PHRASES)), buckets), "ppm-counts")
    for kind_done in (WORDS, PHRASES):
        freed(blocks, part=f"kind={kind_done}")
    types = counted.where((F.col("kind") == WORDS) & F.col("block").isNull()).agg(F.coalesce(F.sum("types"), F.lit(0))).first()[0]
    floor = np.log10(train_tokens + 0.5 * (types + 1))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    empty = lambda *names: [F.lit(None).cast(t).alias(c) for c, t in (("bucket", "int"), ("keys", "binary"), ("answer", "binary"), ("held", "array<boolean>"), ("sizes", "array<long>"), ("ids", f"array<{kind}>")) if c in names]
    order = ["block", "kind", "bucket", "keys", "answer", "held", "sizes", "ids"]
    priced = _window_answers(asked, low, buckets).select("*", *empty("bucket", "held", "sizes", "ids")).select(order)
    counts = counted.where("block is not null").select("block", "kind", "bucket", "answer", *empty("keys", "held", "sizes", "ids")).select(order)
    rows = priced.unionByName(counts).unionByName(texts.select("block", "kind", F.col("texts").alias("answer"), "held", "sizes", "ids", *empty("bucket", "keys")).select(order))
    dealt = rows.repartition(min(4 * n_blocks + 1, TASKS), "block").sortWithinPartitions("block", "kind")

    def run(batches):
        found: dict[int, list] = {WINDOWS: [], WORDS: [], PHRASES: []}
        for batch in batches:
            for i, what in enumerate(batch.column(1).to_pylist()):
                bucket, keys, answer = (batch.column(c)[i].as_py() for c in (2, 3, 4))
                if what == TEXTS:
                    yield from scored(batch.column(7)[i].values, batch.column(5)[i].as_py(), batch.column(6)[i].as_py(), zstandard.ZstdDecompressor().decompressobj().decompress(answer), found)
                    found = {k: [] for k in found}
                elif what == WINDOWS:
                    found[what].append((unpacked(keys, np.uint64, True), unpacked_values(answer)))
                else:
                    found[what].append((bucket, unpacked(answer, np.int64)))

    def scored(ids, held, sizes, data, found):
        ends = np.cumsum(sizes)
        pieces = np.split(np.arange(len(held)), np.flatnonzero(np.diff(ends // PIECE)) + 1)
        streams = lambda part: [data[ends[i] - sizes[i] : ends[i]] for i in part]
        words = [tokens(streams(part)) for part in pieces]
        keys, cost = (np.concatenate([x[j] for x in found[WINDOWS]]) for j in (0, 1))
        order = np.argsort(keys)
        keys, cost = keys[order], cost[order]
        tables = {WORDS: _table(np.concatenate([h for h, _ in words]), buckets, found[WORDS]), PHRASES: _table(np.concatenate([x for w in words for x in phrases(*w)[2:]]), buckets, found[PHRASES])}
        look = lambda kind, x: tables[kind][1][np.searchsorted(tables[kind][0], x)]
        for part, (hashes, n) in zip(pieces, words):
            texts = streams(part)
            c = look(WORDS, hashes)
            begins = np.cumsum(n) - n
            known = np.add.reduceat((c > 0).astype(np.int64), begins)
            base = np.add.reduceat(np.log10(c + 0.5), begins) - n * floor
            score = _text_scores(texts, hashes, n, _lengths(texts, keys, cost), lambda x: look(PHRASES, x))
            columns = [n, known, np.full(len(n), train_tokens, np.int64), base, score]
            yield pa.RecordBatch.from_arrays([ids.slice(part[0], len(part)), pa.array(held[part[0] : part[-1] + 1], pa.bool_()), *map(pa.array, columns)], names=names)

    return dealt.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
