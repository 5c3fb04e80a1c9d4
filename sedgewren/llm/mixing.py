"""Mixing sources to target weights by subset-sum budget fitting.

Every source has a word budget.  Whole passes over the source are taken first; what remains of the budget is fitted by
choosing documents: documents are counted by exact length, each length gives its share rounded down, and a bounded
knapsack over the documents left, counted by length, finds the choice that comes nearest to the rest of the budget.
Which documents of a length are chosen is decided by a seeded hash of their rows, so reruns agree.

Nothing here gathers a source in one task: lengths are counted in hash buckets of a few thousand documents, the knapsack
sees one row for each distinct length of a source, and only the one bucket of a length that is taken in part is ranked.

Defined cases: null text has size 0, and documents of size 0 are never taken (nor do they need to be); the null source
is a source of its own and stands last; a source without words has target 0; repeated rows are documents of their own
and count each time; a null doc_id is a value like any other; an empty table gives an empty result.  Any number of sources:
they are numbered by ranges and shared out by aggregates, and joined by a shuffle where they are too many to send.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgewren.llm.common import WORD_PATTERN, small, staged

#: Documents in a hash bucket of one source and length, about.
BUCKET_ROWS = 2000
#: Words that are left to the knapsack where the sums of all documents are too many, and the number of sums that are not.
TABLE_WORDS, SUMS = 1 << 16, 1 << 18


def word_count(text: str | Column = "text") -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def shared_out(sources: DataFrame, weights: list[float], most: float) -> DataFrame:
    """Append target to (place, source_size): all sizes shared by weight, which repeat by place; a share stops at ``most`` times
    the size, and the excess goes to the others by weight.

    Each round is one aggregate over the sources: those that the share of the round would take above their bound are bounded.
    """
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("place") % len(weights) + 1).cast("int"))
    sources = sources.withColumn("_weight", weight)
    bound, size = F.lit(float(most)) * F.col("source_size"), F.col("source_size")
    total, all_of = sources.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.sum("_weight"), F.lit(0.0))).first()
    left, by, bounded = float(total), all_of, -1
    while by:
        over = F.lit(left) * F.col("_weight") / F.lit(by) > bound
        n, taken, rest = sources.agg(F.coalesce(F.sum(over.cast("long")), F.lit(0)), F.coalesce(F.sum(F.when(over, size)), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("_weight"))), F.lit(0.0))).first()
        if n == bounded or not n:
            break
        bounded, left, by = n, float(total - most * taken), rest
    share = F.lit(left) * F.col("_weight") / F.lit(by) if by else bound
    return sources.withColumn("target", F.least(share, bound)).drop("_weight")


def placed_sources(sizes: DataFrame, source: str) -> DataFrame:
    """Number the sources in code-point order, null last, without gathering them."""
    key = F.col(source)
    tasks = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = sizes.repartitionByRange(tasks, key.isNull(), key).sortWithinPartitions(key.isNull(), key)
    ranged = staged(ranged.withColumn("_row", F.monotonically_increasing_id()), "mix-sources")
    part = F.shiftright("_row", 33)
    before, first = 0, []
    for r in sorted(ranged.groupBy(part.alias("p")).count().collect()):  # one row for each task
        first += [F.lit(r["p"]), F.lit(before)]
        before += r["count"]
    offset = F.element_at(F.create_map(*first), part) if first else F.lit(0)
    return ranged.withColumn("place", (offset + F.col("_row") - F.shiftleft(part, 33)).cast("long")).drop("_row")


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to choose so that their words come nearest to ``budget``.

    Exact where the different sums up to twice the budget are at most ``SUMS``, which holds for few or for small documents.  With more
    sums, documents are chosen by shares, largest ones first, until some ``TABLE_WORDS`` words are missing; the shortest documents,
    that many words of them at least, are kept out of this, and the knapsack then runs over all that are left.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return np.zeros_like(counts)
    if budget >= total:
        return counts.copy()
    exact = _nearest(lengths, counts, budget, SUMS)
    if exact is not None:
        return exact
    short = np.argsort(lengths, kind="stable")
    upto = np.cumsum((lengths * counts)[short])
    kept = short[: int(np.searchsorted(upto, 2 * TABLE_WORDS)) + 1]
    free = counts.copy()
    free[kept] = 0
    spare_words = int((lengths * free).sum())
    aim = max(0, budget - TABLE_WORDS)
    chosen = np.array([int(c) * min(aim, spare_words) // spare_words for c in free], np.int64) if spare_words else np.zeros_like(counts)
    left = budget - int((chosen * lengths).sum())
    for i in short[::-1]:  # large documents first, until the rest fits the table
        n = min(int(free[i] - chosen[i]), max(0, left - TABLE_WORDS // 2) // int(lengths[i])) if lengths[i] else 0
        chosen[i] += n
        left -= n * int(lengths[i])
    return chosen + _nearest(lengths, counts - chosen, left)


def _nearest(lengths: np.ndarray, counts: np.ndarray, budget: int, most: int | None = None) -> np.ndarray | None:
    """The choice whose sum is nearest to ``budget`` (of two the smaller sum), by the sums that can be reached; None beyond ``most`` sums.

    No choice comes nearer than none does if it exceeds the budget by as much, so sums end at twice the budget.
    """
    span, chosen = 2 * budget, np.zeros_like(counts)
    order = np.argsort(-lengths, kind="stable")
    items = [(int(lengths[i]) * k, i, k) for i in order if counts[i] and 0 < lengths[i] <= span for k in _powers(min(int(counts[i]), span // int(lengths[i])))]
    sums, by = np.zeros(1, np.int64), np.full(1, -1, np.int32)  # sums in order, and the item that first reached each
    for n, (w, _, _) in enumerate(items):
        new = sums[: np.searchsorted(sums, span - w, "right")] + w
        at = np.searchsorted(sums, new)
        new = new[sums[np.minimum(at, len(sums) - 1)] != new]
        if most is not None and len(sums) + len(new) > most:
            return None
        if len(new):
            both = np.concatenate((sums, new))
            place = np.argsort(both, kind="stable")
            sums, by = both[place], np.concatenate((by, np.full(len(new), n, np.int32)))[place]
        if sums[np.searchsorted(sums, budget) - (budget > sums[-1])] == budget:
            break
    at = int(sums[np.argmin(np.abs(sums - budget))])
    while at:
        w, i, k = items[by[np.searchsorted(sums, at)]]
        chosen[i] += k
        at -= w
    return chosen


def _powers(n: int) -> list[int]:
    """1, 2, 4 ... and a rest that together give every number up to ``n``."""
    out, k = [], 1
    while n > 0:
        out.append(min(k, n))
        n -= k
        k *= 2
    return out


def mix(docs: DataFrame, size: str, weights: list[float], most: int = 3, seed: int = 17, source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """Append source_size, target and taken: the words that the mix takes of each document, repeats counted.

    The sources, in code-point order with null last, have ``weights``, repeated as needed; ``most`` bounds both a
    source's target and a document's repeats.  ``docs`` is written to the shared folder once, so pass slim columns.
    Columns of the three names are replaced; all others pass through, whatever their names.
    """
    docs = docs.drop("source_size", "target", "taken")
    names = [F.col(f"`{c}`") for c in docs.columns]
    # the caller's columns travel in one, so no name of this plan can clash with theirs
    kept = docs.select(F.struct(*names).alias("row"), F.col(source).alias("source"), F.col(size).cast("long").alias("size"), F.xxhash64(F.lit(seed), *names).alias("hash"))
    kept = staged(kept, "mix")
    histogram = staged(kept.groupBy("source", "size").agg(F.count("*").alias("count")), "mix-lengths")
    sizes = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("count")).alias("source_size"))
    plan = staged(shared_out(placed_sources(sizes, "source"), weights, most), "mix-plan")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = plan.withColumn("passes", whole.cast("int")).withColumn("rest", F.when(F.col("source_size") > 0, F.rint(F.col("target") - F.col("passes") * F.col("source_size"))).otherwise(0).cast("long"))
    plan = small(staged(plan.withColumnRenamed("source", "planned"), "mix-quotas"))

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        # a source's lengths, one row each: at most about the square root of twice its words
        return group.assign(more=fit(group["size"].to_numpy(), group["count"].to_numpy(), int(group["rest"].iloc[0])))[["place", "size", "more"]]

    on = F.col("source").eqNullSafe(F.col("planned"))
    lengths = histogram.join(plan, on).drop("source", "planned")
    chosen = lengths.select("place", "size", "count", "rest").where("rest > 0 and size > 0").groupBy("place").applyInPandas(choose, "place long, size long, more long")
    buckets = F.greatest(F.lit(1), F.ceil(F.col("count") / BUCKET_ROWS)).cast("long")
    quota = lengths.join(chosen, ["place", "size"], "left").select("place", "size", "source_size", "target", "passes", F.coalesce("more", F.lit(0)).alias("more"), buckets.alias("buckets"))
    quota = small(staged(quota, "mix-quota"))
    dealt = kept.join(plan.select("planned", "place"), on).drop("planned", "source").join(quota, ["place", "size"]).withColumn("bucket", F.pmod("hash", "buckets"))
    before = Window.partitionBy("place", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    part = dealt.where("more > 0").groupBy("place", "size", "bucket").agg(F.count("*").alias("n"), F.first("more").alias("quota")).withColumn("quota", F.col("quota") - F.coalesce(F.sum("n").over(before), F.lit(0)))
    split = part.where("quota > 0 and quota < n").select("place", "size", F.col("bucket").alias("edge"), "quota")
    # without a bucket taken in part, all buckets whose predecessors leave something of the quota are taken whole
    full = part.where("quota >= n").groupBy("place", "size").agg(F.max("bucket").alias("last"))
    split = small(staged(split.join(full, ["place", "size"], "full"), "mix-edges"))
    edge = dealt.join(split, ["place", "size"], "left")
    inside = F.coalesce(F.col("bucket") == F.col("edge"), F.lit(False))
    ranked = edge.where(inside).withColumn("rank", F.row_number().over(Window.partitionBy("place", "size").orderBy("hash", F.col(f"row.`{doc_id}`")))).withColumn("extra", (F.col("rank") <= F.col("quota")).cast("int"))
    others = edge.where(~inside).withColumn("extra", F.coalesce((F.col("bucket") <= F.col("last")).cast("int"), F.lit(0)))
    columns = ["row.*", "source_size", "target", (F.col("size") * (F.col("passes") + F.col("extra"))).alias("taken")]
    return ranked.select(*columns).unionByName(others.select(*columns))
