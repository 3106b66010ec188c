"""Dense 0..n-1 ids in a total order, without a global window or the driver.

Plan: range-partition + sort within partitions on a total key, stamp each
row with (partition id, monotonically increasing id) and write that once as a
table in the shared folder (so a lost executor cannot re-derive other offsets,
and columns the caller drops are not read again), then add per-partition start offsets. The offsets table has one row
per partition (its size is bounded by the partition count, so broadcasting it
is safe) and is the only thing ever ordered globally.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefspark.functions.core import hash_bigint
from prefspark.session import materialize


def dense_rank_ids(df: DataFrame, order_by: list, out: str = "row_id",
                   num_partitions: int | None = None) -> DataFrame:
    """Add ``out`` = 0..n-1 following ``order_by`` (must be a total order)."""
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c) if isinstance(c, str) else c for c in order_by]
    s = (df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
         .withColumn("_pid", F.spark_partition_id())
         .withColumn("_mid", F.monotonically_increasing_id()))
    s = materialize(s, "dense-ids")
    offs = s.groupBy("_pid").agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = offs.withColumn("_start", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    return (s.join(F.broadcast(offs.select("_pid", "_first", "_start")), "_pid")
            .withColumn(out, F.col("_start") + F.col("_mid") - F.col("_first"))
            .drop("_pid", "_mid", "_first", "_start"))


def dense_ids(df: DataFrame, order_col: str, out: str = "prompt_id") -> DataFrame:
    """``out`` = 0..n-1 in source order (``order_col`` gives the order)."""
    return dense_rank_ids(df, [order_col], out)


def hash_rank(df: DataFrame, id_col: str, seed: int, out: str, by=(), hash_parts=None) -> DataFrame:
    """0..n-1 within each ``by`` group in the order (md5(seed|parts), id), without
    a global sort and without one task per group.

    The 32-bit hash is uniform, so its top 16 bits split every group into up
    to 65,536 even buckets: bucket sizes come from one aggregation, bucket
    start offsets from a prefix sum over that (small) counts table, and the
    rank inside a bucket from ``row_number`` over a window partitioned by
    (group, bucket) -- even a group holding a third of all rows is spread over
    65,536 window partitions. With no ``by`` the offsets table has at most
    65,536 rows and is broadcast. Deterministic (no partition ids), so no
    checkpoint is needed. ``id_col`` must be unique within a group.
    """
    by = list(by)
    parts = hash_parts if hash_parts is not None else [F.col(id_col)]
    x = df.withColumn("_h", hash_bigint(F.lit(str(seed)), *parts)).withColumn("_b", F.shiftright("_h", 16))
    counts = x.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    ws = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1) if by else \
        Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(ws), F.lit(0))).select(*by, "_b", "_start")
    if not by:
        starts = F.broadcast(starts)  # at most 65,536 rows
    w = Window.partitionBy(*by, "_b").orderBy("_h", id_col)
    return (x.withColumn("_rn", F.row_number().over(w)).join(starts, [*by, "_b"])
             .withColumn(out, F.col("_start") + F.col("_rn") - 1).drop("_h", "_b", "_rn", "_start"))


def seeded_shuffle(df: DataFrame, id_col: str, seed: int, out: str = "shuffle_rank") -> DataFrame:
    """A reproducible permutation: rank by (md5(seed|id), id).

    Only the ids are ranked; other columns meet their rank in one join and never
    pass through a window. ``id_col`` must be unique and not null. A ``df`` that is
    dear to compute should be a written table: it is read three times, twice for
    the ids alone."""
    ranks = hash_rank(df.select(id_col), id_col, seed, out)
    return ranks if df.columns == [id_col] else df.join(ranks, id_col)


def top_histogram(keys: DataFrame) -> list[tuple[int, int]]:
    """Counts per top-16-bit bucket of ``_h`` (at most 65,536 rows)."""
    return [(r["b"], r["count"]) for r in keys.groupBy(F.shiftright("_h", 16).alias("b")).count().collect()]


def kth_smallest_key(keys: DataFrame, k: int, top: list[tuple[int, int]] | None = None) -> tuple[int, object]:
    """The k-th smallest (0-based) ``(_h, _id)`` of a key table whose ``_h`` is a
    uniform 32-bit hash and ``_id`` a unique id, without sorting the table.

    Two histogram passes (top 16 bits, then low 16 bits inside one bucket;
    each returns at most 65,536 counts to the driver) locate the exact hash
    value; only the keys sharing that one 32-bit value (about n / 2^32 of
    them) are ordered by id, and only the first few are fetched.
    """
    def pick(counts, target):
        acc = 0
        for b, c in sorted(counts):
            if acc + c > target:
                return b, acc
            acc += c
        raise ValueError("k out of range")

    top = top if top is not None else top_histogram(keys)
    b1, below1 = pick(top, k)
    low = (keys.filter(F.shiftright("_h", 16) == b1)
           .groupBy(F.col("_h").bitwiseAND(F.lit(0xFFFF)).alias("b")).count().collect())
    b2, below2 = pick([(r["b"], r["count"]) for r in low], k - below1)
    hv = (b1 << 16) | b2
    rest = k - below1 - below2
    ids = keys.filter(F.col("_h") == hv).select("_id").orderBy("_id").limit(rest + 1).collect()
    return hv, ids[rest]["_id"]


def train_validation_split(df: DataFrame, id_col: str, train_fraction: float = 0.8, seed: int = 42,
                           exact: bool = True, persist_keys: bool = True) -> DataFrame:
    """Add ``split``: the first floor(frac * n) rows of the seeded permutation
    (order by md5(seed|id), then id) are 'train', the rest 'validation'.

    Exact sizes without a global sort: the cut-off key is found by histogram
    selection (``kth_smallest_key``) on the narrow key, then applied to the
    full table as a plain filter predicate (no join, no shuffle of wide rows).
    ``id_col`` must be unique. ``exact=False`` uses a hash threshold (sizes
    approximately ``frac``, no extra pass). ``persist_keys=False`` when ``df``
    is already a cheap columnar read (the passes then just re-read two columns).
    """
    h = hash_bigint(F.lit(str(seed)), F.col(id_col))
    if not exact:
        return df.withColumn("split", F.when(h < F.lit(int(train_fraction * (1 << 32))), F.lit("train"))
                             .otherwise(F.lit("validation")))
    # narrow keys, kept for the three small selection passes only (an
    # executor loss just recomputes them from lineage)
    keys = df.select(h.alias("_h"), F.col(id_col).alias("_id"))
    if persist_keys:
        keys = keys.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        top = top_histogram(keys)
        n = sum(c for _, c in top)
        k = int(Decimal(str(train_fraction)) * n)  # exact floor, no binary rounding
        if k <= 0:
            return df.withColumn("split", F.lit("validation"))
        if k >= n:
            return df.withColumn("split", F.lit("train"))
        ch, cid = kth_smallest_key(keys, k, top)
    finally:
        if persist_keys:
            keys.unpersist()
    below = (h < F.lit(ch)) | ((h == F.lit(ch)) & (F.col(id_col) < F.lit(cid)))
    return df.withColumn("split", F.when(below, F.lit("train")).otherwise(F.lit("validation")))
