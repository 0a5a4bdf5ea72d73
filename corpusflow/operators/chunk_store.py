"""The stored chunk table: partitioned by user bucket, bucketed and sorted by chunk id.

A lookup reads only the partitions of the users that ask, and meets the chunks bucket by bucket, so
their content is not shuffled. A delete rewrites only the partitions that hold its victims; all
other files stay as they are.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.operators import mutations
from corpusflow.session import staged

OVERWRITE_CONF = "spark.sql.sources.partitionOverwriteMode"


@dataclass
class ChunkStore:
    """A chunk table at ``path``, known to the session as ``name``."""

    spark: SparkSession
    path: str
    name: str
    user_buckets: int
    id_buckets: int
    columns: list[str]

    def bucket_of(self, user: str = "user_id"):
        return F.pmod(F.xxhash64(user), F.lit(self.user_buckets)).cast("int")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def _placed(self, rows: DataFrame) -> DataFrame:
        """One task per partition and bucket, as the files are laid out; a hot tenant has a task per bucket."""
        placed = rows.withColumn("user_bucket", self.bucket_of()).select(*self.columns, "user_bucket")
        return placed.repartition("user_bucket", F.pmod(F.hash("chunk_id"), F.lit(self.id_buckets)))

    def append(self, chunks: DataFrame, documents: DataFrame) -> None:
        """Chunks of documents that still exist for their user."""
        self._placed(mutations.append_chunks(chunks, documents)).write.insertInto(self.name)

    def partitions_of(self, rows: DataFrame, user: str = "user_id") -> list[int]:
        """The user buckets of some rows: at most ``user_buckets`` numbers."""
        return sorted(r[0] for r in rows.where(F.col(user).isNotNull()).select(self.bucket_of(user)).distinct().collect())

    def holding(self, asked: DataFrame) -> DataFrame:
        """The partitions that can hold chunks of the users of ``asked`` (user_id)."""
        return self.table().where(F.col("user_bucket").isin(self.partitions_of(asked)))

    def delete(self, victims: DataFrame) -> DataFrame:
        """Remove the chunks of ``victims`` (document_id, user_id), rewriting the partitions with such chunks.

        Returns the removed (chunk_id, document_id, user_id). Survivors of the touched partitions are written
        beside the table first and replace them in one dynamic overwrite; a partition without survivors
        is overwritten with nothing. Partitions without a victim are neither read again nor written.
        """
        keys = ["document_id", "user_id"]
        wanted = staged(victims.select(*keys).distinct(), "victims")
        gone = staged(self.holding(wanted).join(wanted, keys, "left_semi").select("chunk_id", *keys), "removed-chunks")
        touched = self.partitions_of(gone)
        if not touched:
            return gone
        reached = self.table().where(F.col("user_bucket").isin(touched))
        left = staged(reached.join(wanted, keys, "left_anti"), "survivors", "user_bucket")
        alive = {r[0] for r in left.select("user_bucket").distinct().collect()}
        before = self.spark.conf.get(OVERWRITE_CONF)
        self.spark.conf.set(OVERWRITE_CONF, "dynamic")
        try:
            self._placed(left.drop("user_bucket")).write.insertInto(self.name, overwrite=True)
        finally:
            self.spark.conf.set(OVERWRITE_CONF, before)
        nothing = ", ".join(f"cast(null as {f.dataType.simpleString()})" for f in reached.drop("user_bucket").schema)
        for bucket in touched:
            if bucket not in alive:
                self.spark.sql(f"insert overwrite table {self.name} partition (user_bucket = {bucket}) select {nothing} from range(0)")
        self.spark.catalog.refreshTable(self.name)
        return gone

    def files(self) -> DataFrame:
        """(user_bucket, path) of the files that hold rows."""
        return self.table().select("user_bucket", F.input_file_name().alias("path")).distinct()

    def forget(self) -> None:
        """Drop the name; the files stay."""
        self.spark.sql(f"drop table if exists {self.name}")


def open_store(spark: SparkSession, path: str, schema: str, user_buckets: int = 64, id_buckets: int = 8) -> ChunkStore:
    """The store at ``path`` (new or existing) with columns ``schema`` (DDL), which must have chunk_id and user_id.

    The numbers of buckets are part of the layout: open a store with those it was written with.
    """
    name = f"chunk_store_{uuid.uuid4().hex}"
    # Makes the folder of a new store, and adds nothing to an old one.
    spark.createDataFrame([], f"{schema}, user_bucket int").write.mode("append").partitionBy("user_bucket").parquet(path)
    spark.sql(
        f"create table {name} ({schema}, user_bucket int) using parquet partitioned by (user_bucket) "
        f"clustered by (chunk_id) sorted by (chunk_id) into {id_buckets} buckets location '{path}'"
    )
    spark.sql(f"msck repair table {name}")
    columns = [c for c in spark.table(name).columns if c != "user_bucket"]
    return ChunkStore(spark, path, name, user_buckets, id_buckets, columns)
