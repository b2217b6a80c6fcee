"""Differences between two copies of a dataset, located with a column-by-bucket checksum matrix.

Both copies are hashed row by row and column by column; the hashes of a key bucket are added up, so a matrix of buckets x columns
describes each copy, whatever the order of its rows. Only the buckets and columns in which the two matrices differ are read again and
joined field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veloframe.storage import materialize, shuffle_partitions

#: Unequal buckets up to this many rows (16 bytes each) are broadcast; beyond it they are joined by a shuffle on the bucket.
BROADCAST_BUCKETS = 1_000_000


def latest_rows(df: DataFrame, key: str, newest: str) -> DataFrame:
    """The row of each key with the greatest ``newest`` (nulls are oldest; among ties any one row, so ties should agree).

    The limit works map-side too, so of a hot key each task sends one row."""
    w = Window.partitionBy(key).orderBy(F.col(newest).desc_nulls_last())
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def _bucket(key: str, buckets: int, parts: int) -> Column:
    """A bucket lies within one partition of a shuffle by key into ``parts``, so its rows are added up before the matrix is shuffled."""
    return (F.pmod(F.hash(key), F.lit(parts)).cast("long") * buckets + F.pmod(F.xxhash64(F.col(key), F.lit("bucket")), F.lit(buckets))).cast("long")


def checksum_matrix(df: DataFrame, key: str, columns: list[str], buckets: int, newest: str | None = None) -> DataFrame:
    """One row per non-empty bucket: ``bucket``, ``n`` and for the key and each column two additive 32-bit limbs of 64-bit hashes.

    Hashes include the key, so values swapped between two keys of a bucket are seen. Each sum of limbs is exact up to 2^31 rows a bucket.
    Older versions of a key go map-side before the shuffle by key, and sums of a bucket meet before the shuffle by bucket, so neither a hot
    key nor a hot bucket reaches one task whole. buckets: per partition of the shuffle."""
    parts = shuffle_partitions(df.sparkSession)
    hashes = [F.xxhash64(F.col(key), F.lit(-1)).alias("_h0")] + [F.xxhash64(F.col(key), F.lit(i), F.col(c)).alias(f"_h{i}") for i, c in enumerate(columns, 1)]
    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("_key"), *([F.col(newest).alias("_newest")] if newest else []), *hashes)
    rows = latest_rows(rows, "_key", "_newest") if newest else rows.repartition(parts, "_key")
    sums = []
    for i in range(len(columns) + 1):
        sums += [F.sum(F.col(f"_h{i}").bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"lo{i}"), F.sum(F.shiftrightunsigned(f"_h{i}", 32)).alias(f"hi{i}")]
    return rows.groupBy(_bucket("_key", buckets, parts).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), *sums)


def unequal_cells(first: DataFrame, second: DataFrame, columns: list[str]) -> DataFrame:
    """``bucket`` and a bit mask: bit 0 for another set of keys, bit i for the i-th column."""
    cells = ["n"] + [f"{p}{i}" for i in range(len(columns) + 1) for p in ("lo", "hi")]
    a = first.select("bucket", *(F.col(c).alias(f"a_{c}") for c in cells))
    b = second.select("bucket", *(F.col(c).alias(f"b_{c}") for c in cells))
    differ = lambda c: ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    mask = F.when(differ("n") | differ("lo0") | differ("hi0"), 1).otherwise(0)
    for i in range(1, len(columns) + 1):
        mask = mask + F.when(differ(f"lo{i}") | differ(f"hi{i}"), 1 << i).otherwise(0)
    return a.join(b, "bucket", "full_outer").select("bucket", mask.cast("int").alias("mask")).filter("mask <> 0")


def differences(first: DataFrame, second: DataFrame, key: str, columns: list[str], newest: str | None = None, rows_per_bucket: int = 8) -> DataFrame:
    """Rows ``key, field_name``: ``only_in_first``, ``only_in_second``, or a column in which both copies have the key and differ.

    Values are compared as stored and null equals only null. With ``newest``, a key may have several rows in a copy and the one with the
    greatest ``newest`` counts; without it keys must be unique. Rows whose key is null identify nothing and are left out. Further columns
    are ignored, whatever their names. Empty copies give ``only_in_...`` for every key of the other; two empty copies give no rows.

    ``rows_per_bucket`` trades the size of the matrix against what is read again: with a share d of differing keys, about
    1 - (1 - d)^rows_per_bucket of the rows are. It is no limit; a bucket may hold any number of rows."""
    need = list(dict.fromkeys([key, *columns, *([newest] if newest else [])]))
    first, second = first.select(*need), second.select(*need)
    parts = shuffle_partitions(first.sparkSession)
    buckets = max(1, max(first.count(), second.count()) // (rows_per_bucket * parts))  # of each partition; the counts are from the footers of the files
    cells = materialize(unequal_cells(checksum_matrix(first, key, columns, buckets, newest), checksum_matrix(second, key, columns, buckets, newest), columns), "unequal")
    found = cells.agg(F.count(F.lit(1)).alias("n"), F.bit_or("mask").alias("mask")).first()
    read = [c for i, c in enumerate(columns, 1) if (found.mask or 0) >> i & 1]
    small = found.n <= BROADCAST_BUCKETS

    def side(df: DataFrame, tag: str) -> DataFrame:
        rows = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("_key"), *([F.col(newest).alias("_newest")] if newest else []), *(F.col(c).alias(f"{tag}{i}") for i, c in enumerate(read)), _bucket(key, buckets, parts).alias("bucket"))
        rows = rows.join(F.broadcast(cells) if small else cells, "bucket").drop("bucket").withColumnRenamed("mask", f"{tag}mask")
        rows = latest_rows(rows, "_key", "_newest") if newest else rows
        return rows.drop("_newest").withColumn(f"{tag}is", F.lit(True))

    both = F.col("a_is").isNotNull() & F.col("b_is").isNotNull()
    names = [F.when(F.col("b_is").isNull(), F.lit("only_in_first")), F.when(F.col("a_is").isNull(), F.lit("only_in_second"))]
    for i, c in enumerate(read):
        bit = 1 << (columns.index(c) + 1)
        names.append(F.when(both & (F.col("a_mask").bitwiseAND(F.lit(bit)) != 0) & ~F.col(f"a_{i}").eqNullSafe(F.col(f"b_{i}")), F.lit(c)))
    joined = side(first, "a_").join(side(second, "b_"), "_key", "full_outer")
    return joined.select(F.col("_key").alias(key), F.explode(F.array_compact(F.array(*names))).alias("field_name"))
