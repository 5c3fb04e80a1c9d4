"""A stored lexical index in segments: chunks are added, documents taken out, and small segments merged, without tokenizing twice.

A segment is written once and never changed: its forward rows (the terms of each chunk, sorted by document).  Searches of many queries
read these.  Postings and heads, in the layout of ``lexical``, are made of them when a search of few queries first meets the segment, and
kept; segments that were merged before that never had any.  Documents that are taken out are named in a table of tombstones (segment, document); the same
document can be added again later, as another segment.  The vocabulary (term, df) is carried along by sums: added chunks count up,
and those taken out count down by their forward rows, so it equals that of an index built anew.  One small table says which
folders are in force and how many chunks and tokens each segment still has; switching it (see catalog.Store) commits a change as a whole.

Segments of a like size (by powers of ``FANOUT``) are merged when there are ``FANOUT`` of them: their forward rows, less those of
documents taken out, become one segment.  So a chunk is written again once for each power, and searches meet few segments.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedgewren.operators import lexical
from sedgewren.operators.catalog import Store
from sedgewren.sources.stage import freed, located, small, staged

FANOUT = 4
#: Windows of one segment at most; a window's number is the segment's times this and its own.
STRIDE = 1 << 32
#: Ids that are named to the scan of the forward rows; more are joined.
LISTED = 500
STATE = "kind string, segment int, name string, path string, chunks long, tokens long, windows int"


class SegmentedIndex:
    """The index in a folder; a new session that opens the folder finds it as it was."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.store = Store(spark, f"{self.path}/state")

    def state(self) -> list:
        """One row for each segment, and one for the folders of tombstones and vocabulary."""
        return self.store.read().collect() if self.store.exists() else []

    def _segments(self, rows: list | None = None) -> list:
        return sorted((r for r in (self.state() if rows is None else rows) if r["kind"] == "segment"), key=lambda r: r["segment"])

    def _folder(self, rows: list, kind: str) -> DataFrame | None:
        found = [r["path"] for r in rows if r["kind"] == kind]
        return self.spark.read.parquet(found[0]) if found else None

    def _written(self, df: DataFrame, kind: str, by: str | None = None) -> str:
        path = f"{self.path}/{kind}-{uuid.uuid4().hex}"
        out = df.write.option("parquet.block.size", lexical.GROUP)
        (out.partitionBy(by) if by else out).parquet(path)
        return path

    def _commit(self, segments: list[tuple], tombstones: str | None, vocabulary: str | None) -> None:
        rows = [("segment", *s) for s in segments]
        rows += [(kind, None, None, path, None, None, None) for kind, path in (("tombstones", tombstones), ("vocabulary", vocabulary)) if path]
        self.store.write(self.spark.createDataFrame(rows, STATE).coalesce(1))

    def _paths(self, rows: list) -> tuple[str | None, str | None]:
        at = {r["kind"]: r["path"] for r in rows if r["kind"] != "segment"}
        return at.get("tombstones"), at.get("vocabulary")

    def _segment(self, forward: DataFrame, number: int, name: str) -> tuple:
        """Write a segment of forward rows (chunk_id, document_id, chunk_index, folder, dl, terms) and describe it.

        What an attempt that failed has left under this number is written over.
        """
        for kind in ("postings", "heads"):
            self._drop(f"{self.path}/{kind}/segment={number}")
        forward.write.mode("overwrite").parquet(f"{self.path}/forward/segment={number}")
        chunks, tokens = self._read("forward", [number]).agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        return number, name, None, chunks, tokens, max(1, -(-chunks // lexical.WINDOW))

    def _posted(self, numbers: list[int], windows: list[int]) -> None:
        """Make the postings and heads of these segments that no search has asked for yet."""
        names = self._names("heads")
        for number, most in zip(numbers, windows):
            if f"segment={number}" in names:
                continue
            window = F.lit(number) * F.lit(STRIDE) + F.pmod(F.xxhash64("document_id"), F.lit(most))
            flat = self._read("forward", [number]).select(*lexical.PLACE, "dl", window.cast("long").alias("window"), F.explode("terms").alias("t")).select("*", F.col("t.term").alias("term"), F.col("t.tf").alias("tf")).drop("t")
            self._made("postings", number, lexical.clustered(flat, self.buckets).write.option("parquet.block.size", lexical.GROUP).partitionBy("bucket"))
            self._made("heads", number, lexical.heads_of(self._postings([number])).write)

    def _made(self, kind: str, number: int, out: DataFrameWriter) -> None:
        """Write a folder of a segment aside and rename it as a whole, if there is none. Of two sessions that do so at once one has its folder
        moved into the other's, where its name hides it from readers."""
        where, system = located(self.spark, f"{self.path}/{kind}/segment={number}")
        if not system.exists(where):
            aside = f"{self.path}/_{kind}-{uuid.uuid4().hex}"
            out.parquet(aside)
            system.mkdirs(where.getParent())
            system.rename(located(self.spark, aside)[0], where)

    def _postings(self, segments: list[int]) -> DataFrame:
        """Their schema is named, as a segment without a term has no file of postings."""
        fields = [f for f in self._read("forward", segments).schema if f.name in (*lexical.PLACE, "dl")]
        named = {"window": T.LongType(), "term": T.StringType(), "tf": T.LongType(), "segment": T.IntegerType(), "bucket": T.IntegerType()}
        return self._read("postings", segments, T.StructType([*fields, *(T.StructField(c, t) for c, t in named.items())]))

    def _read(self, kind: str, segments: list[int], schema: T.StructType | None = None) -> DataFrame:
        """Rows of these segments, with the segment's number; no other folder is listed."""
        read = self.spark.read.schema(schema) if schema else self.spark.read
        return read.option("basePath", f"{self.path}/{kind}").parquet(*(f"{self.path}/{kind}/segment={n}" for n in segments))

    def _vocabulary(self, old: DataFrame | None, change: DataFrame) -> str:
        """``change``: term, df to be added, or to be taken away where negative."""
        rows = change if old is None else old.select("term", "df").unionByName(change)
        sums = rows.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        return self._written(sums.withColumn("bucket", lexical.bucket_of(F.col("term"), self.buckets)).sortWithinPartitions("bucket", "term"), "vocabulary")

    def add(self, chunks: DataFrame, name: str | None = None) -> None:
        """Add chunks (chunk_id, document_id, chunk_index, folder, text), each one row. A name that is already there is not added again, so a
        batch of a stream can be repeated."""
        rows = self.state()
        segments = self._segments(rows)
        name = name or uuid.uuid4().hex
        if any(name in r["name"].split("+") for r in segments):
            return
        place = ["chunk_id", *lexical.PLACE]
        ordered = chunks.select(*place, "text").repartitionByRange("document_id").sortWithinPartitions("document_id", "chunk_index")
        new = self._segment(lexical.forward(ordered, *place), max([r["segment"] for r in segments], default=-1) + 1, name)
        change = self._read("forward", [new[0]]).select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        vocabulary = self._vocabulary(self._folder(rows, "vocabulary"), change)
        self._commit([*(tuple(r)[1:] for r in segments), new], self._paths(rows)[0], vocabulary)

    def append(self, chunks: DataFrame, number: int) -> None:
        """For ``then`` of streaming.ingest.ingest(): one segment for each micro-batch, merged as they add up."""
        self.add(chunks, f"batch-{number}")
        self.merge()

    def delete(self, gone: DataFrame) -> None:
        """Take out the documents of ``gone`` (document_id). Ids that are not there, null among them, change nothing."""
        rows = self.state()
        segments = self._segments(rows)
        if not segments:
            return
        ids = gone.select("document_id").where("document_id is not null").distinct()
        named = [r[0] for r in ids.limit(LISTED + 1).collect()]
        forward, before = self._read("forward", [r["segment"] for r in segments]), self._folder(rows, "tombstones")
        many = staged(ids, "gone") if len(named) > LISTED else None
        held = forward.where(F.col("document_id").isin(named)) if many is None else forward.join(small(many), "document_id", "left_semi")
        if before is not None:
            held = held.join(small(before), ["segment", "document_id"], "left_anti")
        taken = self._written(held.select("segment", "document_id", "chunk_id", "dl", "terms"), "taken")
        if many is not None:
            freed(many)
        held = self.spark.read.parquet(taken)
        less = {r["segment"]: (r["c"], r["t"]) for r in held.groupBy("segment").agg(F.count("*").alias("c"), F.sum("dl").alias("t")).collect()}
        if less:
            new = held.select("segment", "document_id").distinct()
            tombstones = self._written(new if before is None else before.unionByName(new), "tombstones")
            change = held.select(F.explode("terms.term").alias("term")).groupBy("term").agg((-F.count("*")).alias("df"))
            vocabulary = self._vocabulary(self._folder(rows, "vocabulary"), change)
            left = [(r["segment"], r["name"], None, r["chunks"] - less.get(r["segment"], (0, 0))[0], r["tokens"] - less.get(r["segment"], (0, 0))[1], r["windows"]) for r in segments]
            self._commit(left, tombstones, vocabulary)
        self._drop(taken)

    def merge(self, least: int = FANOUT) -> int:
        """Merge segments of a like size where there are ``least`` of them; the number of merges."""
        merges = 0
        while True:
            rows = self.state()
            tiers: dict[int, list] = {}
            for r in self._segments(rows):
                tiers.setdefault(int(math.log(max(1, r["chunks"]), FANOUT)), []).append(r)
            some = next((t for _, t in sorted(tiers.items()) if len(t) >= max(2, least)), None)
            if some is None:
                return merges
            self._merge(rows, some)
            merges += 1

    def _merge(self, rows: list, some: list) -> None:
        numbers = [r["segment"] for r in some]
        tombstones, vocabulary = self._paths(rows)
        live = self._read("forward", numbers)
        if tombstones:
            stones = self.spark.read.parquet(tombstones)
            live = live.join(small(stones), ["segment", "document_id"], "left_anti")
            tombstones = self._written(stones.where(~F.col("segment").isin(numbers)), "tombstones")
        # each task sorts what it reads of the sorted files, so nothing is shuffled
        new = self._segment(live.drop("segment").sortWithinPartitions("document_id", "chunk_index"), max(r["segment"] for r in self._segments(rows)) + 1, "+".join(r["name"] for r in some))
        self._commit([*(tuple(r)[1:] for r in self._segments(rows) if r["segment"] not in numbers), new], tombstones, vocabulary)

    def _held(self) -> tuple[list, list]:
        """The state and its segments, of which there must be one."""
        rows = self.state()
        segments = self._segments(rows)
        if not segments:
            raise ValueError(f"{self.path} holds no index yet")
        return rows, segments

    def _live(self, rows: list, segments: list) -> DataFrame:
        """Forward rows of the chunks that count."""
        live, stones = self._read("forward", [r["segment"] for r in segments]), self._folder(rows, "tombstones")
        return (live if stones is None else live.join(small(stones), ["segment", "document_id"], "left_anti")).drop("segment")

    def forward(self) -> lexical.Forward:
        """What lexical.search() reads for many queries, over all segments."""
        rows, segments = self._held()
        return lexical.Forward(self._live(rows, segments), self._folder(rows, "vocabulary"), sum(r["chunks"] for r in segments), sum(r["tokens"] for r in segments))

    def index(self) -> lexical.Index:
        """What lexical.search() reads for few queries, over all segments; postings that no one has asked for before are made."""
        rows, segments = self._held()
        numbers = [r["segment"] for r in segments]
        self._posted(numbers, [r["windows"] for r in segments])
        posts, heads = self._postings(numbers), self._read("heads", numbers)
        stones, gone = self._folder(rows, "tombstones"), None
        if stones is not None:
            spread = self.spark.createDataFrame([(r["segment"], r["windows"]) for r in segments], "segment int, windows int")
            where = F.col("segment").cast("long") * F.lit(STRIDE) + F.pmod(F.xxhash64("document_id"), F.col("windows"))
            gone = stones.join(F.broadcast(spread), "segment").select(where.cast("long").alias("window"), "document_id")  # one row for each segment
        places = self._live(rows, segments).select("chunk_id", "document_id", "chunk_index")
        return lexical.Index(posts, heads, self._folder(rows, "vocabulary"), sum(r["chunks"] for r in segments), sum(r["tokens"] for r in segments), self.buckets, sum(r["windows"] for r in segments), places, gone)

    def statistics(self) -> DataFrame:
        """term, df, idf; no chunk is read for these."""
        return self.forward().statistics()

    def search(self, queries: DataFrame, pool: int) -> DataFrame:
        """As lexical.search(). Few queries read the postings of their terms, and many the terms of all chunks, once."""
        few = queries.select("query_id").limit(lexical.FEW).count() < lexical.FEW
        return lexical.search(None, queries, pool, self.index() if few else self.forward())

    def vacuum(self) -> list[str]:
        """Delete folders that the state in force doesn't name; readers that began before must have ended."""
        rows = self.state()
        used = {r["path"].rsplit("/", 1)[1] for r in rows if r["path"]} | {f"{kind}/segment={r['segment']}" for r in self._segments(rows) for kind in ("forward", "postings", "heads")}
        old = [n for n in self._names("") if n.startswith(("tombstones-", "vocabulary-", "taken-", "_postings-", "_heads-"))]
        old += [f"{kind}/{n}" for kind in ("forward", "postings", "heads") for n in self._names(kind) if n.startswith("segment=")]
        old = sorted(n for n in old if n not in used)
        for n in old:
            self._drop(f"{self.path}/{n}")
        return old

    def _names(self, folder: str) -> list[str]:
        where, system = located(self.spark, f"{self.path}/{folder}")
        return [x.getPath().getName() for x in system.listStatus(where)] if system.exists(where) else []

    def _drop(self, path: str) -> None:
        where, system = located(self.spark, path)
        system.delete(where, True)
