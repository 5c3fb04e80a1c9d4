"""Document and folder registries, deduplication, and versioned tables without a database."""

from __future__ import annotations

import calendar
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UNCATEGORIZED = "Uncategorized"


def content_hash(content: Column) -> Column:
    return F.md5(content)


def ingest_status(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Append hash and status: "indexed", or "skipped" for a file whose content is known or comes earlier in the batch.

    ``files`` has ord (the order of arrival, one number for each file) and content; ``known`` has hash. The hash is also the document's id.
    Only (hash, ord) is aggregated, with a partial minimum in each task, and what is first is joined back by ord, so neither the
    content nor a hash that many files share is moved to one place.
    """
    rows = files.withColumn("hash", content_hash(F.col("content")))
    first = rows.groupBy("hash").agg(F.min("ord").alias("ord"))
    if known is not None:
        first = first.join(known.select("hash").distinct(), "hash", "left_anti")
    status = F.when(F.col("_first"), "indexed").otherwise("skipped")
    return rows.join(first.select("ord", F.lit(True).alias("_first")), "ord", "left").withColumn("status", status).drop("_first")


NO_TEXT = "Could not extract text"


def file_outcomes(pages: DataFrame, chunks: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """path, filename, hash, status, error, pages, chunks_created of each file of a batch, one row for each.

    ``pages`` has files.SCHEMA; ``chunks`` has hash, whose documents they are. A file with a broken page, or without any chunk, is
    an error; one whose content is known, or which an earlier file (by path) of the batch brings, is skipped. Errors make no
    content known.
    """
    files = pages.groupBy("path", "filename", "hash").agg(F.max("page_count").alias("pages"), F.min(F.when(F.col("status") == "error", F.struct(F.coalesce("page_num", F.lit(0)).alias("at"), "error"))).alias("broken"))
    made = chunks.groupBy("hash").agg(F.count("*").alias("made"))
    rows = files.join(made, "hash", "left").withColumn("error", F.coalesce("broken.error", F.when(F.col("made").isNull(), NO_TEXT)))
    first = rows.where("error is null").groupBy("hash").agg(F.min("path").alias("path"))
    if known is not None:
        first = first.join(known.select("hash").distinct(), "hash", "left_anti")
    rows = rows.join(first.select("path", F.lit(True).alias("_first")), "path", "left")
    status = F.when(F.col("error").isNotNull(), "error").when(F.col("_first"), "indexed").otherwise("skipped")
    return rows.select("path", "filename", "hash", status.alias("status"), "error", "pages", F.when(status == "indexed", F.col("made")).otherwise(0).cast("long").alias("chunks_created"))


def sound_pages(pages: DataFrame) -> DataFrame:
    """Pages of the files that were read whole; of files of equal content, those of the first by path. document_id is the hash."""
    broken = pages.where("status = 'error'").select("path").distinct()
    good = pages.join(broken, "path", "left_anti")
    first = good.groupBy("hash").agg(F.min("path").alias("path")).select("path")
    return good.join(first, "path", "left_semi").withColumn("document_id", F.col("hash"))


def batch_summary(outcomes: DataFrame) -> DataFrame:
    """One row: indexed, skipped, errors, total."""
    count = lambda s: F.count_if(F.col("status") == s)
    return outcomes.agg(count("indexed").alias("indexed"), count("skipped").alias("skipped"), count("error").alias("errors"), F.count("*").alias("total"))


def without_chunks(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents that gave no chunk and are refused."""
    return documents.join(chunks.select("document_id").distinct(), "document_id", "left_anti")


def registry(chunks: DataFrame) -> DataFrame:
    """document_id, filename, folder, pages, chunks: what the first chunk of a document says, and the number of chunks."""
    first = F.min_by(F.struct("filename", "folder"), F.struct("page_num", "chunk_index"))
    rows = chunks.groupBy("document_id").agg(first.alias("f"), F.max("page_num").alias("pages"), F.count("*").alias("chunks"))
    return rows.select("document_id", "f.filename", "f.folder", "pages", "chunks")


def folders(registered: DataFrame, documents: DataFrame) -> DataFrame:
    """name, place: registered folders and the documents' own, without the empty one, numbered by name."""
    names = registered.select("name").union(documents.select(F.col("folder").alias("name"))).where("name is not null and name <> ''").distinct()
    # one row for each folder, as in folder_tree()
    return names.withColumn("place", F.row_number().over(Window.orderBy("name")))


def create_folder(registered: DataFrame, name: str) -> DataFrame:
    """Add a folder unless it is there."""
    if not name.strip():
        raise ValueError("a folder needs a name")
    new = registered.sparkSession.createDataFrame([(name.strip(),)], "name string")
    return registered.select("name").unionByName(new.join(registered, "name", "left_anti"))


def delete_folder(registered: DataFrame, name: str) -> DataFrame:
    """Drop a folder from the registry; its documents keep their folder."""
    return registered.where(F.col("name") != name)


def rename_folder(rows: DataFrame, old: str, new: str, column: str = "folder") -> DataFrame:
    return rows.withColumn(column, F.when(F.col(column) == old, new).otherwise(F.col(column)))


def rename_registered(registered: DataFrame, old: str, new: str) -> DataFrame:
    """The registry after a rename: the old name goes, the new one is there once, whether or not it was before."""
    if not new.strip():
        raise ValueError("a folder needs a name")
    return create_folder(delete_folder(registered, old), new)


def move_document(rows: DataFrame, document_id, folder: str) -> DataFrame:
    return rows.withColumn("folder", F.when(F.col("document_id") == document_id, folder).otherwise(F.col("folder")))


def delete_documents(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows without those of the documents in ``gone``."""
    return rows.join(gone.select("document_id").distinct(), "document_id", "left_anti")


def delete_everywhere(stores: dict[str, Store], registry: Store, gone: DataFrame) -> None:
    """Delete the documents in ``gone`` from each store (chunks, vectors, postings, hashes, ...), from the registry last.

    Every store is tried. If one fails the registry keeps the documents, so that they stay visible and the call can be
    repeated; the error names the stores that failed.
    """
    failed = {}
    for name, store in stores.items():
        try:
            store.write(delete_documents(store.read(), gone))
        except Exception as e:  # noqa: BLE001
            failed[name] = str(e)[:200]
    if failed:
        raise RuntimeError(f"not deleted everywhere, repeat the deletion: {failed}")
    registry.write(delete_documents(registry.read(), gone))


def insert_new(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Append rows whose key is new; of equal new keys one is kept."""
    return table.unionByName(rows.dropDuplicates([key]).join(table.select(key), key, "left_anti"))


def folder_tree(documents: DataFrame, registered: DataFrame | None = None) -> DataFrame:
    """folder, n_docs, n_chunks, place: folders by name, those without documents too, the uncategorized last."""
    rows = documents.select(F.coalesce(F.nullif("folder", F.lit("")), F.lit(UNCATEGORIZED)).alias("folder"), F.lit(1).alias("d"), "chunks")
    if registered is not None:
        rows = rows.unionByName(registered.select(F.col("name").alias("folder"), F.lit(0).alias("d"), F.lit(0).cast("long").alias("chunks")))
    tree = rows.groupBy("folder").agg(F.sum("d").alias("n_docs"), F.sum("chunks").alias("n_chunks"))
    # one row for each folder: a catalogue is small, so it can be numbered in one place
    return tree.withColumn("place", F.row_number().over(Window.orderBy(F.col("folder") == UNCATEGORIZED, "folder")))


def comparable(documents: DataFrame) -> DataFrame:
    """folder, names, n_docs, top_k: folders of at least two named documents, with what a comparison asks for."""
    named = documents.where("filename <> ''").groupBy("folder").agg(F.array_sort(F.collect_list("filename")).alias("names"), F.count("*").alias("n_docs"))
    return named.where("n_docs >= 2").select("folder", F.array_join("names", ", ").alias("names"), "n_docs", (F.col("n_docs") * 4).alias("top_k"))


def kept_snapshots(snapshots: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Snapshots that are not older than ``days``."""
    return snapshots.where(F.col("created_at") >= now - F.make_interval(days=F.lit(days)))


class Store:
    """A table in versioned Parquet folders, switched by numbered pointer files, so that readers see whole versions only.

    A pointer is written aside and then renamed to the next number; nothing that a reader may need is deleted or replaced first,
    so a crash leaves the last whole version in force. Versions before the last two are deleted after a switch.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _pointers(self) -> list[str]:
        where, system = self._at("pointers")
        names = [x.getPath().getName() for x in system.listStatus(where)] if system.exists(where) else []
        return sorted(n for n in names if not n.startswith(("_", ".")))

    def _version(self, pointer: str) -> str:
        return self.spark.read.text(f"{self.path}/pointers/{pointer}").first()[0]

    def exists(self) -> bool:
        return bool(self._pointers())

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self._version(self._pointers()[-1])}")

    def create(self, schema) -> None:
        """Make an empty table if there is none."""
        if not self.exists():
            self.write(self.spark.createDataFrame([], schema))

    def write(self, rows: DataFrame, partition_by: list[str] | None = None) -> None:
        """Write a new version, then point to it."""
        version, before = f"v-{uuid.uuid4().hex}", self._pointers()
        out = rows.write
        (out.partitionBy(*partition_by) if partition_by else out).parquet(f"{self.path}/{version}")
        aside, system = self._at(f".{version}")
        stream = system.create(aside, True)
        stream.write(bytearray(version.encode()))
        stream.close()
        system.mkdirs(self._at("pointers")[0])
        target = self._at(f"pointers/{int(before[-1]) + 1 if before else 0:020d}")[0]
        if system.exists(target) or not system.rename(aside, target):
            raise RuntimeError(f"another writer switched {self.path} meanwhile")
        for old in before[:-1]:
            for name in (self._version(old), f"pointers/{old}"):
                system.delete(self._at(name)[0], True)

    def snapshot(self, folder: str) -> str:
        """Copy the version in force below ``folder`` and give the copy's path."""
        name = f"{folder.rstrip('/')}/{time.strftime('%Y-%m-%d-%H-%M-%S', time.gmtime())}-{uuid.uuid4().hex[:8]}.snapshot"
        self.read().write.parquet(name)
        return name

    def restore(self, snapshot: str) -> None:
        self.write(self.spark.read.parquet(snapshot))

    def expire(self, folder: str, days: int = 7) -> list[str]:
        """Delete the snapshots below ``folder`` that were made more than ``days`` days ago, and name them."""
        made = [(n, calendar.timegm(time.strptime(n[:19], "%Y-%m-%d-%H-%M-%S"))) for n in self._names(folder) if n.endswith(".snapshot")]
        old = [n for n, at in made if at < time.time() - days * 86_400]
        for n in old:
            where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{n}")
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        return old

    def _names(self, folder: str) -> list[str]:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        system = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(x.getPath().getName() for x in system.listStatus(where)) if system.exists(where) else []

    def info(self) -> dict:
        try:
            return {"points": self.read().count()}
        except Exception as e:
            return {"error": str(e)[:200]}
