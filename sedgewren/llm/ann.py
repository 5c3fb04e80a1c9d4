"""Approximate nearest neighbours by additive quantisation and exact reranking.

A unit vector is approximated by the sum of one full-dimensional codeword from each of ``BOOKS`` codebooks.  Codebooks are
fitted to residuals, one after the other, on at most ``SAMPLE`` vectors chosen by a hash of their ids; every vector is then
encoded by a beam search that keeps the ``BEAM`` best sums over the codebooks so far.  Codes are stored with what the sum leaves of
the vector, in one byte a dimension at a scale of its own, and with the lengths of both rests.  A query's products with all codewords form
a table, and sums of ``BOOKS`` table entries give a candidate's distance from it as far as the codes tell; the length of the rest says how
far that may be off.  Candidates that may still be among the nearest are refined by their rests, which is done for as many as the
vectors ask for: codes that fit some rows badly, or that cannot tell rows of a dense cluster apart, refine more of them.  Of the refined
ones those within their remaining error of the nearest, but a query's ``DEPTH`` best of all candidates and those equal to the last of them at
most, are reranked by the exact cosine, so the number of pairs that are reranked does not grow with the table.  Cosines are formed of vectors scaled by powers of two,
which changes none of their digits, so that squares of very large or small components stay finite.

An error of the codes is taken to be at most its own length, and, in all but the nearest ``SHARE``th of a block by the codes, ``SURE`` standard
deviations of a rest of that length in a random direction.

Equal vectors are one candidate, which takes one place of the depth and stands for its ``k`` + 1 smallest ids.

Codes (a byte a dimension and some thirty more) lie in blocks of about ``BLOCK`` rows and queries in blocks of ``QUERIES``; a block
of queries meets each block of codes in one row of a join on the code block's number. Only the best candidates leave a task.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part, neither as query nor as
candidate, nor do rows of a null id; vectors of each length are searched among themselves; with fewer candidates than
``k`` all are returned; ties go to the smaller id; repeated rows are candidates of their own, and of query rows that repeat an id the
least vector is asked for; a query's own row (its id) is no candidate; an empty table gives an empty result; other columns are not
read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgewren.llm.common import small, staged

BOOKS, WORDS = 16, 256
SAMPLE = 10_000
BEAM = 4
BLOCK, QUERIES = 32_768, 512
DEPTH = 160
SHARE, SURE = 16, 5.0


def fit_codebooks(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Codebooks (books, words, dimensions) fitted to residuals by k-means."""
    rng = np.random.default_rng(seed)
    rest, out = x.astype(np.float32).copy(), np.zeros((books, words, x.shape[1]), np.float32)
    for m in range(books):
        c = rest[rng.choice(len(rest), words, replace=len(rest) < words)].copy()
        for _ in range(rounds):
            near = (0.5 * (c * c).sum(1) - rest @ c.T).argmin(1)
            n = np.bincount(near, minlength=words)
            total = np.zeros_like(c)
            np.add.at(total, near, rest)
            c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], rest[rng.choice(len(rest), words)])
        near = (0.5 * (c * c).sum(1) - rest @ c.T).argmin(1)
        rest -= c[near]
        out[m] = c
    return out


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows, books) by beam search, and the norms of the sums."""
    n, d = x.shape
    m, words, _ = books.shape
    codes = np.zeros((n, m), np.uint8)
    norms = np.zeros(n, np.float32)
    half = 0.5 * (books * books).sum(2)
    for a in range(0, n, 512):
        rest, rows = x[a : a + 512].astype(np.float32)[:, None, :], min(512, n - a)
        chosen, cost = np.zeros((rows, 1, 0), np.uint8), np.zeros((rows, 1), np.float32)
        for j in range(m):
            loss = cost[:, :, None] + half[j] - rest @ books[j].T  # half the squared error, less half the squared norm
            flat = loss.reshape(rows, -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            parent, word = best // words, best % words
            at = np.arange(rows)[:, None]
            cost = flat[at, best]
            rest = rest[at, parent] - books[j][word]
            chosen = np.concatenate([chosen[at, parent], word[:, :, None].astype(np.uint8)], axis=2)
        top = cost.argmin(1)
        codes[a : a + rows] = chosen[np.arange(rows), top]
        # summed from the codewords, so that equal codes have equal norms
        total = np.zeros((rows, d), np.float32)
        for j in range(m):
            total += books[j][codes[a : a + rows, j]]
        norms[a : a + rows] = np.linalg.norm(total, axis=1)
    return codes, norms


def rests(x: np.ndarray, books: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the sums of codewords leave of vectors, in bytes; and the scale of these, the rest's length and the length of what bytes leave."""
    left = x - sums(books, codes)
    scale = (np.abs(left).max(axis=1) / 127).astype(np.float32).astype(np.float64)
    whole = np.rint(left / np.where(scale > 0, scale, 1.0)[:, None]).clip(-127, 127).astype(np.int8)
    error = np.linalg.norm(left - whole * scale[:, None], axis=1)
    return whole, np.stack([scale, np.linalg.norm(left, axis=1), error], axis=1)


def sums(books: np.ndarray, codes: np.ndarray) -> np.ndarray:
    total = np.zeros((len(codes), books.shape[2]))
    for j in range(len(books)):
        total += books[j][codes[:, j]]
    return total


def best_of_block(queries: np.ndarray, books: np.ndarray, codes: np.ndarray, left: np.ndarray, sizes: np.ndarray, k: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries and of the candidates that may be among the ``k`` nearest of the block, at most the ``depth`` nearest and those equal to
    the last of them, and their negative distances. ``left`` and ``sizes`` are as rests() gives them."""
    n, d = len(codes), books.shape[2]
    table = np.einsum("qd,mwd->mwq", queries, books.astype(np.float64))
    found = sums(books, codes)
    square = np.repeat(1.0 + (found * found).sum(1)[:, None], len(queries), axis=1)
    for j in range(len(books)):
        square -= 2 * table[j][codes[:, j]]
    scale, rest, error = sizes.T
    asking, best, near = [], [], []
    for i, q in enumerate(queries):
        far = np.sqrt(np.maximum(square[:, i], 0.0))
        likely = far * far + rest * rest
        refined = lambda at: np.linalg.norm(q - found[at] - left[at] * scale[at, None], axis=1)  # noqa: E731, B023
        first = np.argpartition(likely, min(depth, n) - 1)[:depth]
        limit = np.partition(refined(first) + error[first], k - 1)[k - 1] if len(first) >= k else np.inf
        may = far - rest <= limit + 1e-7
        if may.sum() > depth:
            doubtful = likely - 2 * SURE * far * rest / np.sqrt(d) <= limit * limit + 1e-7
            may &= doubtful | (likely <= np.partition(likely, n // SHARE)[n // SHARE])
        may[first] = True
        at = np.flatnonzero(may)
        exact = refined(at)
        limit = np.partition(exact + error[at], k - 1)[k - 1] if len(at) >= k else np.inf
        kept = exact - error[at] <= limit + 1e-15
        if kept.sum() > depth:
            kept &= exact <= np.partition(exact[kept], depth - 1)[depth - 1]
        asking.append(np.full(kept.sum(), i))
        best.append(at[kept])
        near.append(-exact[kept])
    return np.concatenate(asking), np.concatenate(best), np.concatenate(near)


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, v, d) with v in double precision and d its length, of the rows that take part."""
    e = F.col(embedding)
    fine = e.isNotNull() & F.col(vec_id).isNotNull() & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(vec_id).cast("long").alias("id"), F.transform(e.cast("array<double>"), lambda x: x + F.lit(0.0)).alias("v"))  # no negative zeros
    return rows.withColumn("d", F.size("v"))


def _blocks(rows: DataFrame, number: Column, f, schema: str) -> DataFrame:
    """One row for each block of rows; ``f`` packs ids and vectors, and a block has a bounded number of rows."""
    names = [x.split()[0] for x in schema.split(", ")]
    dealt = rows.withColumn("block", number).repartition("block").sortWithinPartitions("block", "id")

    def run(batches):
        held, block = [], None
        for batch in batches:
            b, ids = batch.column(2).to_numpy(zero_copy_only=False), batch.column(0).to_numpy(zero_copy_only=False)
            v = np.asarray(batch.column(1).flatten()).reshape(len(ids), -1)
            for part in np.split(np.arange(len(b)), np.flatnonzero(np.diff(b)) + 1):
                if not len(part):
                    continue
                if b[part[0]] != block and held:
                    yield pack(block, held)
                    held = []
                block = b[part[0]]
                held.append((ids[part], v[part]))
        if held:
            yield pack(block, held)

    def pack(block, held):
        row = f(int(block), np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
        return pa.RecordBatch.from_arrays([pa.array([x], pa.int64() if isinstance(x, int) else pa.binary()) for x in row], names=names)

    return dealt.select("id", "v", "block").mapInArrow(run, schema)


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # squares of very large or small components would not be finite
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def scaled(v: Column) -> Column:
    """A vector times the power of two that brings its largest component near 1."""
    power = F.least(F.greatest(-F.floor(F.log2(F.array_max(F.transform(v, F.abs)))), F.lit(-1022)), F.lit(1023)).cast("double")
    return F.transform(v, lambda x: x * F.pow(F.lit(2.0), power))


def search(vectors: DataFrame, is_query: Column, k: int = 5, depth: int = DEPTH) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for each query row, nearest first.

    ``is_query`` is a condition over the column id.
    """
    rows = usable(vectors)
    found = None
    for (d,) in rows.select("d").distinct().orderBy("d").collect():  # one length, as a rule
        part = _search(rows.where(F.col("d") == d).drop("d"), is_query, k, depth)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _search(rows: DataFrame, is_query: Column, k: int, depth: int) -> DataFrame:
    """The search among vectors of one length."""
    spark = rows.sparkSession
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()  # a bounded sample
    books = fit_codebooks(unit(np.array([r["v"] for r in sample])))
    d = books.shape[2]
    shared = spark.sparkContext.broadcast(books)
    queries = staged(rows.where(is_query).groupBy("id").agg(F.min("v").alias("v")), "queries")
    query_blocks = max(1, -(-queries.count() // QUERIES))
    keyed = rows.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v"))

    def coded(batches):
        for batch in batches:
            if batch.num_rows:
                x = unit(np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1))
                codes, _ = encode(x, shared.value)
                left, sizes = rests(x, shared.value, codes)
                packed = [c.tobytes() + v.tobytes() + z.tobytes() for c, v, z in zip(codes, left, sizes)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(packed, pa.binary())], names=["id", "h1", "h2", "code"])

    each = staged(keyed.mapInArrow(coded, "id long, h1 long, h2 long, code binary"), "codes")
    # a vector's smallest ids and how often each is repeated; the limit is taken in each task before the shuffle
    least = Window.partitionBy("h1", "h2").orderBy("id")
    members = each.groupBy("h1", "h2", "id").agg(F.count("*").alias("times")).withColumn("place", F.row_number().over(least)).where(F.col("place") <= k + 1)
    members = staged(members.drop("place"), "members")
    index = staged(each.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.min("code").alias("code")).withColumn("id", F.monotonically_increasing_id()), "distinct")
    code_blocks = -(-index.count() // BLOCK)

    def gathered(batches):
        held, block = [], None
        for batch in batches:
            for b, i, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if b != block and held:
                    yield packed_codes(block, held)
                    held = []
                block = b
                held.append((i, c))
        if held:
            yield packed_codes(block, held)

    def packed_codes(block, held):
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([np.array([h[0] for h in held], np.int64).tobytes()], pa.binary()), pa.array([b"".join(h[1] for h in held)], pa.binary())], names=["block", "ids", "codes"])

    dealt = index.select(F.pmod(F.xxhash64("id", "code"), F.lit(code_blocks)).alias("block"), "id", "code").repartition("block").sortWithinPartitions("block", "id")
    code_table = staged(dealt.mapInArrow(gathered, "block long, ids binary, codes binary"), "code-blocks")
    asked = _blocks(queries, F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(query_blocks)), lambda b, ids, v: (b, ids.astype(np.int64).tobytes(), v.astype(np.float64).tobytes()), "query_block long, query_ids binary, vectors binary")
    asked = staged(asked, "query-blocks").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(code_blocks - 1).cast("long"))))

    def scored(batches):
        books = shared.value
        m, width = len(books), len(books) + d + 24
        for batch in batches:
            for qi, qv, ci, cc in zip(*(batch.column(i) for i in range(4))):
                q = np.frombuffer(qi.as_py(), np.int64)
                v = unit(np.frombuffer(qv.as_py(), np.float64).reshape(len(q), d))
                ids = np.frombuffer(ci.as_py(), np.int64)
                packed = np.frombuffer(cc.as_py(), np.uint8).reshape(len(ids), width)
                codes, left, sizes = packed[:, :m], packed[:, m:-24].view(np.int8), np.ascontiguousarray(packed[:, -24:]).view(np.float64)
                for a in range(0, len(q), 64):
                    asking, best, near = best_of_block(v[a : a + 64], books, codes, left, sizes, k + 1, depth)
                    yield pa.RecordBatch.from_arrays([pa.array(q[a : a + 64][asking]), pa.array(ids[best]), pa.array(near)], names=["query_id", "id", "near"])

    met = asked.join(code_table, "block").select("query_ids", "vectors", "ids", "codes")
    # the best of all blocks; the limit is taken in each task before the shuffle
    found = met.mapInArrow(scored, "query_id long, id long, near double").withColumn("place", F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("near")))).where(F.col("place") <= depth)
    found = staged(found.select("query_id", "id").join(index.select("id", "h1", "h2", "first"), "id").drop("id"), "found")
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    sized = lambda v: F.struct(v.alias("v"), norm(v).alias("n"))
    # only vectors that some query found are moved
    needed = small(staged(found.select("h1", "h2", "first").distinct(), "needed"))
    one = keyed.select(F.col("id").alias("first"), "h1", "h2", "v").join(needed, ["h1", "h2", "first"], "left_semi").dropDuplicates(["h1", "h2", "first"])
    one = one.select("first", "h1", "h2", scaled(F.col("v")).alias("v")).select("first", "h1", "h2", sized(F.col("v")).alias("v"))
    asking = queries.select(F.col("id").alias("query_id"), scaled(F.col("v")).alias("q")).select("query_id", sized(F.col("q")).alias("q"))
    pairs = found.join(asking, "query_id").join(one, ["h1", "h2", "first"])
    dot = F.aggregate(F.zip_with("q.v", "v.v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    close = pairs.select("query_id", "h1", "h2", (dot / (F.col("q.n") * F.col("v.n"))).alias("score"))
    # one vector at most has no id but the query's own, so k + 1 vectors and those equal to the last are enough
    close = close.withColumn("place", F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("place") <= k + 1)
    rows = close.join(members, ["h1", "h2"]).where("query_id <> id").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("times", F.lit(k)))))
    ranked = rows.select("query_id", F.col("id").alias("vec_id"), "score")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
