"""Sharding by a two-pass external shuffle, in DataFrame operations only.

Pass one scatters the records uniformly over buckets that fit in memory, by a seeded hash.
Pass two shuffles each bucket (Spark's `shuffle` is a Fisher-Yates shuffle of the array)
and writes it. The written buckets, one behind the other, are a random order of all
records, which is then dealt to the shards like cards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.llm.staging import free_name, parts_for, staged, text_bytes

SHARDS = 40
SEED = 20_240_117
#: UTF-8 bytes of text that a bucket holds on average; it is one array in one task.
BUCKET_BYTES = 8 << 20
#: Bytes that a record counts besides its text.
RECORD_BYTES = 16
#: Buckets whose offsets are summed in one group.
OFFSET_GROUP = 4096


def _offsets(buckets: DataFrame) -> DataFrame:
    """bucket -> records in all buckets before it, by sums of groups and sums inside groups."""
    sizes = staged(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "bucket-sizes")
    grouped = sizes.withColumn("g", (F.col("bucket") / OFFSET_GROUP).cast("long"))
    before_group = grouped.groupBy("g").agg(F.sum("n").alias("n")).select(
        "g", (F.sum("n").over(Window.orderBy("g")) - F.col("n")).alias("base"),
    )
    inside = grouped.withColumn("inner", F.sum("n").over(Window.partitionBy("g").orderBy("bucket")) - F.col("n"))
    return inside.join(before_group, "g").select("bucket", (F.col("base") + F.col("inner")).alias("offset"))


def shuffle_into_shards(
    docs: DataFrame, shards: int = SHARDS, seed: int = SEED, text_col: str = "text", bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """All rows and columns of `docs`, shard (0 to shards - 1) and slot (0, 1, ... in each shard).

    Law `rows`: shard sizes differ by one record at most. Every record, also a repeated one or
    one of nulls only, is scattered by a hash of the seed and its place in the input, so no
    group of equal rows meets in one bucket; the number of buckets follows the input. The
    order is repeatable for the same files and settings: a bucket is put into the order of its
    places before it is shuffled, whatever order its blocks arrived in. Empty input gives no rows. Clashing
    input columns stay; the new ones are prefixed with "_" then.
    """
    rows, size = text_bytes(docs, text_col)
    buckets = parts_for(size + RECORD_BYTES * rows, bucket_bytes)
    record = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    placed = docs.select(F.monotonically_increasing_id().alias("place"), record.alias("record"))
    scattered = placed.withColumn(
        "bucket", F.pmod(F.xxhash64(F.lit(seed), F.col("place")), F.lit(buckets)),
    ).repartition(buckets, "bucket")
    # By place only: a record may hold columns without an order.
    in_place = F.array_sort(
        F.collect_list(F.struct("place", "record")), lambda a, b: F.signum(a["place"] - b["place"]).cast("int"),
    )
    shuffled = scattered.groupBy("bucket").agg(in_place.alias("records")).select(
        "bucket", F.posexplode(F.shuffle("records", seed)).alias("at", "placed"),
    ).select("bucket", "at", "placed.record")
    written = staged(shuffled, "shuffled-buckets")
    place = F.col("offset") + F.col("at")
    shard, slot = free_name(docs, "shard"), free_name(docs, "slot")
    return written.join(_offsets(written), "bucket").select(
        *[F.col(f"record.c{i}").alias(c) for i, c in enumerate(docs.columns)],
        (place % shards).cast("int").alias(shard), F.floor(place / shards).cast("long").alias(slot),
    )


def write_shards(docs: DataFrame, path: str, shard_col: str = "shard", slot_col: str = "slot") -> None:
    """Write each shard to its own folder, its records in slot order."""
    docs.repartition(F.col(shard_col)).sortWithinPartitions(shard_col, slot_col).write.partitionBy(shard_col).parquet(path)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    return shuffle_into_shards(docs).select(
        "doc_id", (F.octet_length(text) + RECORD_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
