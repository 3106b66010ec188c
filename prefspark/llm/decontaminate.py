"""Benchmark decontamination by size-partitioned MinHash containment search.

DataFrame functions only. Texts are lower-cased and cut into terms (runs of
letters and digits); a shingle is ``n`` adjacent terms. A document holds an item
if it has at least ``share`` of the item's distinct shingles.

Items are partitioned by their number q of shingles: such an item must have
``r = ceil(share * q)`` shingles in the document, so of any ``q - r + 1`` of its
shingles one is there. Each item posts its ``q - r + 1`` smallest shingle hashes
(its bottom-k MinHash sketch, k by size). A document has no sketch of its own, since a
sketch of a long text says little of a short item; all its shingles meet the posted
hashes in one equi-join, whose condition also leaves out documents of fewer than r
shingles. The pairs found are complete (no candidate is missed by chance). They are
then verified by exact containment on the shingles as text, of candidate
documents only.

The join side of the items is broadcast up to ``BROADCAST_ROWS`` posted hashes
(counted first) and shuffled beyond that. A passage that many documents share
costs each of them a row for each of its few posted hashes.

Defined results: null or empty texts, documents of fewer than ``n`` terms and
items of fewer than ``n`` terms match nothing; an item whose text occurs twice is
matched under both ids; rows of items with one item_id (null included) are versions of one
item, each searched for by itself; rows with one doc_id (null included) are one document; of the
versions and rows of a pair the one with the largest share counts (of equal shares
the longest version); empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefspark.llm.tables import materialize

SHINGLE, SHARE_PERCENT = 5, 80
BROADCAST_ROWS = 500_000


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def shingle_rows(df: DataFrame, n: int) -> DataFrame:
    """A row for each shingle of column ``terms``: the other columns and ``hash`` (repeats included)."""
    keep = [c for c in df.columns if c != "terms"]
    words = [f"w{i}" for i in range(n)]
    zipped = F.arrays_zip(*[F.slice("terms", i + 1, F.greatest(F.size("terms") - (n - 1), F.lit(0))).alias(w) for i, w in enumerate(words)])
    return df.select(*keep, F.inline(zipped).alias(*words)).select(*keep, F.xxhash64(*words).alias("hash"))


def shingle_texts(column: str, n: int) -> Column:
    """Distinct shingles of an array of terms as text."""
    return F.when(F.size(column) >= n, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.size(column) - (n - 1)), lambda i: F.array_join(F.slice(column, i, n), " ")))).otherwise(
        F.array().cast("array<string>"))


def sketches(items: DataFrame, n: int, percent: int) -> DataFrame:
    """version, hash, least: the posted hashes and the shingles a document must have."""
    hashes = shingle_rows(items.select("version", "terms"), n).groupBy("version").agg(F.array_sort(F.collect_set("hash")).alias("all"))
    least = F.ceil(F.size("all") * percent / 100).cast("int")
    return (hashes.withColumn("least", least)
            .select("version", "least", F.explode(F.slice("all", F.lit(1), F.size("all") - F.col("least") + 1)).alias("hash")))


def contained_items(docs: DataFrame, items: DataFrame, n: int = SHINGLE, percent: int = SHARE_PERCENT,
                    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                    item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, n_item (distinct shingles of the item), n_found (those in the document)."""
    own = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    # versions get a number of their own, written once, so that ids may be null or occur several times
    listed = materialize(items.select(F.col(item_col).alias("item_id"), terms(F.col(item_text_col)).alias("terms")).where(F.size("terms") >= n).distinct()
                         .withColumn("version", F.monotonically_increasing_id()), "item-versions")
    posted = materialize(sketches(listed, n, percent), "item-sketches")
    if posted.count() <= BROADCAST_ROWS:
        posted = F.broadcast(posted)
    sized = own.select("doc", terms(F.col("text")).alias("terms")).withColumn("size", F.size("terms") - (n - 1)).where("size > 0")
    candidates = materialize(
        shingle_rows(sized, n).alias("d").join(posted.alias("i"), F.expr("d.hash = i.hash AND size >= least")).select("doc", "version").distinct(), "leak-candidates")
    texts = own.join(candidates.select("doc").distinct().withColumnRenamed("doc", "found"), F.col("doc").eqNullSafe(F.col("found")), "left_semi")
    pairs = texts.join(candidates.withColumnRenamed("doc", "found"), F.col("doc").eqNullSafe(F.col("found"))).select(
        "doc", "version", terms(F.col("text")).alias("terms"))
    exact = listed.select("version", "item_id", shingle_texts("terms", n).alias("item_shingles"))
    found = F.size(F.array_intersect("item_shingles", shingle_texts("terms", n)))
    best = F.max(F.struct((F.col("n_found") / F.col("n_item")).alias("containment"), "n_item", "n_found")).alias("best")
    return (pairs.join(exact, "version").select("doc", "item_id", F.size("item_shingles").cast("long").alias("n_item"), found.cast("long").alias("n_found"))
            .where(F.col("n_found") * 100 >= F.col("n_item") * percent)
            .groupBy("doc", "item_id").agg(best)
            .select(F.col("doc").alias(id_col), F.col("item_id").alias(item_col), "best.n_item", "best.n_found", "best.containment"))
