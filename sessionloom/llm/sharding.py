"""Sharding by a two-pass external shuffle, in DataFrame functions alone.

Pass one gives every record a seeded hash and stores it in the shared folder; its size there
sets how many memory-sized buckets there are. Pass two scatters the records uniformly into the
buckets, shuffles each bucket with Spark's ``shuffle`` (a Fisher-Yates shuffle) and lays the
buckets end to end, which makes one random order of all records. That order is cut into shards
of equal row counts (law ``rows``: counts are at most one apart).

The hash is that of the whole record, so one seed gives one order, however the input is laid out. A
record that comes up very often takes in its row number besides, and is scattered as evenly as all
others; a key or a text that many records share does no harm, as their other columns differ.
Per-bucket totals are the only thing that is accumulated over the whole input: one row for each bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from sessionloom.session import ensure_checkpoint_dir

BUCKET_ROWS = 200_000
BUCKET_BYTES = 64 << 20
#: equal records that may share a bucket, and rows of two numbers that may be broadcast
COPIES, BROADCAST_ROWS = 1000, 100_000


def shuffle_shards(
    records: DataFrame,
    n_shards: int,
    size: str | None = None,
    seed: int = 42,
    bucket_rows: int = BUCKET_ROWS,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """All columns of ``records`` plus ``shard`` (int) and ``slot`` (long), in a random order.

    ``size`` names a column with the bytes that a record takes in a bucket; without it a bucket
    is bounded by rows alone. A bucket holds about ``bucket_bytes`` and ``bucket_rows`` at most,
    and is shuffled in one task's memory.

    Nulls in any column, repeated rows, empty and very long texts are records like all others. Equal
    hashes are ordered by the records themselves. Fewer records than shards leave some shards empty.
    An empty input gives an empty result. Columns need types that can be ordered.
    Input columns named ``shard`` or ``slot`` give way to the new ones; columns named like the
    working columns are kept, as records travel as one struct.
    """
    spark = records.sparkSession
    ensure_checkpoint_dir(spark)
    whole = F.struct(*[F.col(f"`{c}`") for c in records.columns])
    bytes_of = F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0)) if size else F.lit(0).cast("long")
    stored = records.select(
        whole.alias("record"),
        bytes_of.alias("bytes"),
        F.xxhash64(F.lit(seed), whole).alias("key"),
        F.monotonically_increasing_id().alias("row"),
    ).checkpoint()
    often = stored.groupBy("key").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") > COPIES).select("key", F.lit(True).alias("often")).checkpoint()
    repeated = often.count()
    if repeated:
        stored = stored.join(F.broadcast(often) if repeated <= BROADCAST_ROWS else often, "key", "left")
        stored = stored.withColumn("h", F.when(F.col("often"), F.xxhash64("key", "row")).otherwise(F.col("key")))
    else:
        stored = stored.withColumn("h", F.col("key"))
    total = stored.agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b")).first()
    n, held = total["n"], total["b"] or 0
    buckets = max(1, -(-n // bucket_rows), -(-held // bucket_bytes), min(n_shards, n // 1000))
    placed = (
        stored.select(F.pmod(F.col("h"), F.lit(buckets)).cast("int").alias("bucket"), "h", "record")
        # a bucket is the partition of its number, which the shuffle's seed goes by, and is sorted by
        # the hash first: the shuffle is the same after a retry and for every layout of the input
        .repartitionById(buckets, F.col("bucket"))
        .groupBy("bucket")
        .agg(F.shuffle(F.array_sort(F.collect_list(F.struct("h", "record"))), F.lit(seed)).alias("order"))
        .select("bucket", F.posexplode("order").alias("at", "item"))
    )
    sizes = stored.groupBy(F.pmod(F.col("h"), F.lit(buckets)).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))
    # one row for each bucket: the only rows that meet in one task
    before = sizes.select(
        "bucket",
        (F.sum("rows").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("rows")).alias("first"),
    )
    if buckets <= BROADCAST_ROWS:
        before = F.broadcast(before)
    place = F.col("first") + F.col("at")
    # shard s holds the places p with floor(p * shards / n) = s and begins at ceil(s * n / shards)
    shard = F.expr(f"cast((first + at) * {n_shards}L div {max(n, 1)}L as int)")
    begins = F.expr(f"(shard * {max(n, 1)}L + {n_shards - 1}L) div {n_shards}L")
    kept = [F.col(f"item.record.`{c}`") for c in records.columns if c.lower() not in ("shard", "slot")]
    return placed.join(before, "bucket").withColumn("shard", shard).select(*kept, "shard", (place - begins).cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write one folder of Parquet files for each shard, in slot order within each file.

    A task holds neighbouring places of the random order, so it writes to few shards and no
    further shuffle is needed.
    """
    sharded.sortWithinPartitions("shard", "slot").write.mode(mode).partitionBy("shard").parquet(path)
