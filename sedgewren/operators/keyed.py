"""A table of rows by key, in buckets: an upsert writes the buckets that it touches, and a scan can go on where it stopped."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from sedgewren.operators.catalog import Store
from sedgewren.sources.stage import located, small, staged

MANIFEST = "bucket int, version string"


class KeyedStore:
    """Rows with one key each, such as chunks with their vectors.

    A bucket's files lie in a folder of the version that wrote it last; a small table names each bucket's version, and switching that table
    (see catalog.Store) brings an upsert or a deletion into force as a whole. Files of other buckets are neither read nor written.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.manifest = Store(spark, f"{self.path}/manifest")

    def _versions(self) -> dict[int, str]:
        return {r["bucket"]: r["version"] for r in self.manifest.read().collect()} if self.manifest.exists() else {}  # one row for each bucket

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _read(self, versions: dict[int, str]) -> DataFrame:
        paths = [f"{self.path}/data/version={v}/bucket={b}" for b, v in sorted(versions.items())]
        return self.spark.read.option("basePath", f"{self.path}/data").option("mergeSchema", "true").parquet(*paths).drop("version")

    def read(self) -> DataFrame:
        """All rows. Columns that nobody selects, such as vectors, are not read."""
        versions = self._versions()
        if not versions:
            raise ValueError(f"{self.path} holds no rows yet")
        return self._read(versions).drop("bucket")

    def _switch(self, rows: DataFrame, touched: list[int], versions: dict[int, str]) -> None:
        version = uuid.uuid4().hex
        rows.repartition("bucket").sortWithinPartitions("bucket", self.key).write.partitionBy("bucket").parquet(f"{self.path}/data/version={version}")
        where, system = located(self.spark, f"{self.path}/data/version={version}")
        written = {int(x.getPath().getName().split("=")[1]) for x in system.listStatus(where) if x.getPath().getName().startswith("bucket=")}
        kept = {b: v for b, v in versions.items() if b not in touched} | {b: version for b in touched if b in written}
        self.manifest.write(self.spark.createDataFrame(sorted(kept.items()), MANIFEST).coalesce(1))

    def upsert(self, rows: DataFrame, order: str | None = None) -> list[int]:
        """Put rows in, in place of those of the same keys, and name the buckets that were written.

        Of rows that share a key the one with the greatest ``order`` counts; without it keys must be single. Rows without a key are refused.
        """
        columns = [F.col(f"`{c}`") for c in rows.columns]
        new = rows.groupBy(self.key).agg(F.max_by(F.struct(*columns), order).alias("r")).select("r.*") if order else rows
        new = staged(new.withColumn("bucket", self._bucket()), "upsert")
        n, keys, distinct = new.agg(F.count("*"), F.count(self.key), F.count_distinct(self.key)).first()
        if n != keys or keys != distinct:
            raise ValueError(f"{n} rows have {distinct} keys")
        touched = sorted(r[0] for r in new.select("bucket").distinct().collect())
        versions = self._versions()
        before = {b: versions[b] for b in touched if b in versions}
        if before:
            new = self._read(before).join(small(new.select(self.key)), self.key, "left_anti").unionByName(new, allowMissingColumns=True)
        self._switch(new, touched, versions)
        return touched

    def delete(self, keys: DataFrame) -> list[int]:
        """Take out the rows of these keys, and name the buckets that were written."""
        gone = staged(keys.select(self.key).where(F.col(self.key).isNotNull()).distinct().withColumn("bucket", self._bucket()), "deletion")
        versions = self._versions()
        touched = sorted(r[0] for r in gone.select("bucket").distinct().collect() if r[0] in versions)
        if touched:
            left = self._read({b: versions[b] for b in touched}).join(small(gone.select(self.key)), self.key, "left_anti")
            self._switch(left, touched, versions)
        return touched

    def scroll(self, after: tuple | None = None, limit: int = 1000, columns: list[str] | None = None) -> tuple[list[Row], tuple | None]:
        """The next rows by (bucket, key), ``limit`` at most, and the cursor to go on from; None at the end.

        A page reads the folders of the buckets that it shows, and of these the row groups behind the cursor.
        """
        versions, out = self._versions(), []
        for b in sorted(versions):
            if after is not None and b < after[0]:
                continue
            rows = self._read({b: versions[b]})
            if after is not None and b == after[0]:
                rows = rows.where(F.col(self.key) > F.lit(after[1]))
            found = rows.orderBy(self.key).limit(limit - len(out)).select(*(columns or [c for c in rows.columns if c != "bucket"]), F.col(self.key).alias("_at"), F.lit(b).alias("_in")).collect()
            out += found
            if len(out) == limit:
                break
        cursor = (out[-1]["_in"], out[-1]["_at"]) if len(out) == limit else None
        return [Row(**{k: v for k, v in r.asDict().items() if k not in ("_at", "_in")}) for r in out], cursor

    def vacuum(self) -> list[str]:
        """Delete versions that no bucket is read from; readers that began before must have ended."""
        used = set(self._versions().values())
        where, system = located(self.spark, f"{self.path}/data")
        names = [x.getPath().getName() for x in system.listStatus(where)] if system.exists(where) else []
        old = sorted(n for n in names if n.startswith("version=") and n.split("=")[1] not in used)
        for n in old:
            system.delete(located(self.spark, f"{self.path}/data/{n}")[0], True)
        return old
