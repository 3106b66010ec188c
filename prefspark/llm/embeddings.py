"""Embedding near-duplicates by collision-counting projections.

Unit vectors are projected on ``PROJECTIONS`` random directions. Two vectors
collide in a projection if one's value lies in the window of half width
``HALF_WIDTH`` times the link distance centred at the other's: sorted values turn
the window into a range of ranks. Linked vectors collide in each projection with
a known chance, so a pair is verified by its cosine only if it collides in at
least the number of projections that all but ``MISS`` of linked pairs reach.

Counting takes place among vectors that share a cell: the signs of a few further
projections, in as many tables as keep the chance that a linked pair shares no
cell below ``MISS``. The number of signs follows the size of the largest label,
so a cell holds some hundred vectors however large the table is. Larger cells
(many near copies) are dealt in pairs of blocks. Equal vectors are one class and
are counted, not expanded.

Defined results: labels must be equal and not null; vectors that are null, empty,
zero, or hold a null or non-finite component link with nothing (n_links 0, own
component); so does a null label; lengths that differ never link; -0.0 equals
0.0; rows with equal vec_id are rows of their own; a null vec_id takes part but
is a component's id only if all ids there are null; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefspark.llm.components import components
from prefspark.llm.tables import materialize

COSINE = 0.93
PROJECTIONS, HALF_WIDTH = 40, 1.5
MISS = 1e-7
CELL, BLOCK = 512, 2048
STEPS = 2000                 # window half widths are cut into so many steps


def least_count(n: int = PROJECTIONS, miss: float = MISS) -> int:
    """The largest c with a chance below ``miss`` that a linked pair collides fewer than c times in n projections."""
    p, below, c = math.erf(HALF_WIDTH / math.sqrt(2)), 0.0, 0
    while True:
        below += math.comb(n, c) * p**c * (1 - p) ** (n - c)
        if below >= miss:
            return c
        c += 1


def cell_plan(largest: int, cosine: float) -> tuple[int, int]:
    """Signs for each cell, and tables."""
    signs = max(0, math.ceil(math.log2(max(1, largest) / CELL)))
    same = (1 - math.acos(cosine) / math.pi) ** signs
    return signs, 1 if same == 1 else math.ceil(math.log(MISS) / math.log(1 - same))


def directions(d: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, d, n]).normal(size=(d, n))


def unit(lists: pa.Array) -> np.ndarray:
    """Rows of one length as unit vectors in double precision."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    flat = flat / np.abs(flat).max(1, keepdims=True)       # no overflow in the squares
    return flat / np.sqrt((flat * flat).sum(1, keepdims=True))


def same_length(batch: pa.RecordBatch, col: int) -> Iterator[pa.RecordBatch]:
    size = np.diff(batch.column(col).offsets.to_numpy())
    for d in np.unique(size):
        yield batch.filter(pa.array(size == d))


def near_copies(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vec_col: str = "embedding",
                label_col: str = "label") -> DataFrame:
    """A row for each row of vectors: id, n_links, component_id, kept."""
    v = F.col("v")
    real = F.when(v.isNull() | F.col("label").isNull(), False).otherwise(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    plain = F.transform(F.when(real, v), lambda x: x + F.lit(0.0))
    # one class for equal vectors of a label
    rows = rows.select("id", "label", F.when(real, F.xxhash64("label", plain, F.size(plain))).alias("cls"), plain.alias("v"))
    classes = materialize(rows.where("cls is not null").groupBy("cls").agg(
        F.count("*").alias("copies"), F.min("id").alias("rep"), F.first("label").alias("label"), F.first("v").alias("v")), "vector-classes")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    signs, tables = cell_plan(largest, cosine)
    least, distance = least_count(), math.sqrt(2 - 2 * cosine)
    step = HALF_WIDTH * distance / STEPS

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in same_length(whole, 1):
                x = unit(batch.column(1))
                d = x.shape[1]
                places = np.round(x @ directions(d, PROJECTIONS, 1) / step).astype("<i4")
                bits = (x @ directions(d, signs * tables, 2) > 0).reshape(len(x), tables, signs)
                cell = bits @ (1 << np.arange(signs)) if signs else np.zeros((len(x), tables), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.full(len(x), d, np.int32)), pa.array(list(cell.astype(np.int64)), pa.list_(pa.int64())),
                     pa.array([p.tobytes() for p in places], pa.binary())], ["cls", "d", "cells", "places"])

    placed = classes.select("cls", "v").mapInArrow(project, "cls long, d int, cells array<long>, places binary").join(
        classes.select("cls", "label"), "cls")
    posted = placed.select("label", "d", F.posexplode("cells").alias("nth", "cell"), "cls", "places")
    keys = ["label", "d", "nth", "cell"]
    sizes = posted.groupBy(*keys).count().where("count > 1").select(*keys, F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("cls", F.lit(3)), F.col("blocks")).cast("int")
    dealt = (posted.join(sizes, keys).withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select(*keys, F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "cls", "places"))

    def count(group: pa.Table) -> pa.Table:
        cls = group.column("cls").to_numpy()
        own, x, y = group.column("own").to_numpy(), group.column("x")[0].as_py(), group.column("y")[0].as_py()
        places = np.frombuffer(b"".join(group.column("places").to_pylist()), "<i4").reshape(len(cls), -1)
        first, second = np.flatnonzero(own == x), np.flatnonzero(own == y)
        out_a, out_b = [], []
        for a in range(0, len(first), 256):
            query = first[a: a + 256]
            hits = np.zeros((len(query), len(second)), np.int8)
            for j in range(places.shape[1]):
                line = places[second, j]
                order = np.argsort(line, kind="stable")
                rank = np.empty(len(order), np.int32)
                rank[order] = np.arange(len(order), dtype=np.int32)
                low = np.searchsorted(line[order], places[query, j] - STEPS, "left").astype(np.int32)
                high = np.searchsorted(line[order], places[query, j] + STEPS, "right").astype(np.int32)
                hits += (rank >= low[:, None]) & (rank < high[:, None])
            i, k = np.nonzero(hits >= least)
            p, q = cls[query[i]], cls[second[k]]
            ahead = p < q if x == y else p != q
            out_a.append(np.minimum(p, q)[ahead])
            out_b.append(np.maximum(p, q)[ahead])
        none = [np.zeros(0, np.int64)]
        return pa.table({"a": np.concatenate(out_a or none), "b": np.concatenate(out_b or none)})

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in same_length(whole, 2):
                if batch.num_rows:
                    cos = (unit(batch.column(2)) * unit(batch.column(3))).sum(1)
                    yield batch.select([0, 1]).filter(pa.array(cos >= cosine))

    pairs = dealt.groupBy(*keys, "x", "y").applyInArrow(count, "a long, b long").distinct()
    one, two = (classes.select(F.col("cls").alias(c), F.col("v").alias(f"v_{c}")) for c in "ab")
    links = materialize(pairs.join(one, "a").join(two, "b").select("a", "b", "v_a", "v_b").mapInArrow(verify, "a long, b long"), "vector-links")

    copies = classes.select("cls", "copies", "rep")
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = (both.join(copies.select(F.col("cls").alias("b"), "copies"), "b").groupBy("a").agg(F.sum("copies").alias("others"))
              .select(F.col("a").alias("cls"), "others"))
    roots = components(links).withColumnRenamed("node", "cls")
    known = (copies.join(others, "cls", "left").join(roots, "cls", "left")
             .select("cls", "rep", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "cls").alias("root")))
    ids = known.groupBy("root").agg(F.min("rep").alias("component_id"))
    out = rows.select("id", "cls").join(known.join(ids, "root").select("cls", "n_links", "component_id"), "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.cast("long").alias("component_id"), F.coalesce(F.col("id") == component, component.isNull()).alias("kept"))
