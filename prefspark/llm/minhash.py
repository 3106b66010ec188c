"""MinHash near-duplicates by a signature-coordinate inverted join.

A document is the set of its distinct word shingles; equal sets are one class
(copies meet by a hash of the set, before anything else is shuffled). A class
has a signature of ``COORDINATES`` minima. Classes are posted under
(coordinate, value) pairs. Classes of similarity 0.8 agree in ``MATCHES`` of the
coordinates but for a few in a million cases, so a pair must have ``MATCHES``
pairs in common:

* prefix: a class is merged only on its ``COORDINATES - MATCHES + 1`` rarest
  pairs; two classes with enough in common share one of those. Most classes have
  that many pairs of their own and meet nobody;
* skip: the other, longest lists are never merged. What they would add is
  counted from the two signatures once a pair has been found, and pairs below
  ``MATCHES`` collisions end there;
* the rest are confirmed on the full shingle sets.

No group is expanded into all its pairs. First every member of a list is paired
with one member only, the one in the middle (its pivot). Members that are linked with
their pivot are of one component and need no comparison. The other members of a pivot are
compared with all of its members by what they differ in from the pivot, in tiles of bounded
blocks whose products give exact set overlaps; a tile returns a spanning forest of its
links, not pairs. What has another component and another pivot is compared within a
list, again in tiles, by signatures: only pairs with enough collisions leave a tile,
which finds every link that can still join two components.

Defined results: null or white-space-only texts have no shingles, link with
nothing and are their own components; fewer words than a shingle make one
shingle of the whole sequence; rows with equal doc_id are rows of their own and
count as one id; a null doc_id takes part but never is a component's id unless
all of the component's are null; empty tables give no rows; other columns are
ignored. Texts of any length are hashed whole; a worker holds one batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from prefspark.llm.components import components
from prefspark.llm.tables import materialize, partitions_for, release, row_runs, small_batches, text_buffers
from prefspark.llm.words import mixed, word_hashes

COORDINATES, MATCHES, PIVOT_MATCHES = 64, 36, 16
SIMILAR_PERCENT = 80
TILE_MEMBERS, TILE_BYTES, TILE_COLUMNS = 1024, 16 << 20, 4096

_rng = np.random.default_rng(20240607)
_FLIP = _rng.integers(0, 2**64, COORDINATES, np.uint64)
_ODD = _rng.integers(0, 2**64, COORDINATES, np.uint64) | np.uint64(1)


def shingle_sets(col: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw, offs = text_buffers(col)
    for a, b in row_runs(offs, 1 << 20):
        words, first = word_hashes(raw[offs[a]: offs[b]], offs[a: b + 1] - offs[a])
        rolled = np.zeros(max(0, len(words) - n + 1), np.uint64)
        for i in range(n):
            rolled = mixed(rolled * np.uint64(0x9DDFEA08EB382D69) + words[i: len(words) - n + 1 + i]) if len(rolled) else rolled
        for x, y in zip(first.tolist(), first[1:].tolist()):
            if y - x >= n:
                yield np.unique(rolled[x: y - n + 1])
            elif y > x:
                yield words_as_one(words[x:y])
            else:
                yield words[:0]


def words_as_one(words: np.ndarray) -> np.ndarray:
    h = np.full(1, len(words), np.uint64)
    for w in words:
        h = mixed(h * np.uint64(0x9DDFEA08EB382D69) + w)
    return h


def signature(shingles: np.ndarray) -> np.ndarray:
    """The low halves of the minima of ``COORDINATES`` hash functions."""
    low = np.full(COORDINATES, 2**64 - 1, np.uint64)
    for a in range(0, len(shingles), 1024):
        h = (shingles[a: a + 1024] ^ _FLIP[:, None]) * _ODD[:, None]
        h ^= h >> np.uint64(29)
        np.minimum(low, (h * _ODD[:, None]).min(1), out=low)
    return mixed(low).astype(np.uint32)


def set_hash(shingles: np.ndarray) -> int:
    """A hash of the whole set (not null for an empty one)."""
    return int(np.add.reduce(mixed(shingles ^ np.uint64(0x5851F42D4C957F2D))).view(np.int64)) if len(shingles) else 0


def signatures(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """id, text_key (hash of the text), n_shingles, cls (hash of the shingle set), sig (binary; null for an empty set)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, cls, sig = [], [], []
            for s in shingle_sets(batch.column(1), n):
                size.append(len(s))
                cls.append(set_hash(s))
                sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(size, pa.int64()), pa.array(cls, pa.int64()), pa.array(sig, pa.binary())],
                                             ["id", "text_key", "n_shingles", "cls", "sig"])
        release()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    return rows.mapInArrow(run, f"id {kind}, text_key long, n_shingles long, cls long, sig binary")


def posted(classes: DataFrame) -> DataFrame:
    """(key, cls): a row for each class and coordinate, key = coordinate and value."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = np.arange(COORDINATES, dtype=np.int64) << 32
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(-1, COORDINATES)
                cls = np.repeat(part.column(0).to_numpy(), COORDINATES)
                yield pa.RecordBatch.from_arrays([pa.array((sig + high).ravel()), pa.array(cls)], ["key", "cls"])

    return classes.select("cls", "sig").mapInArrow(run, "key long, cls long")


def merged_prefixes(classes: DataFrame) -> DataFrame:
    """(key, cls, score) of the lists that are merged: of each class the rarest pairs, as far as others
    have them too. The score is how often its pairs occur: a group's middle has the largest."""
    shared = posted(classes).groupBy("key").count().where("count > 1")
    lists = posted(classes).join(shared, "key")
    rarest = F.array_sort(F.collect_list(F.struct("count", "key")))       # at most COORDINATES entries
    # pairs that only this class has come first and take up places of the prefix
    prefix = COORDINATES - MATCHES + 1
    return (lists.groupBy("cls").agg(rarest.alias("own"), F.sum("count").alias("score"))
            .select("cls", "score", F.explode(F.slice("own", F.lit(1), F.greatest(F.size("own") - (COORDINATES - prefix), F.lit(0)))).alias("own"))
            .select(F.col("own.key").alias("key"), "cls", "score"))


def collisions(pairs: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """(a, b, matches, n_a, n_b) of the pairs whose whole signatures agree in ``least`` coordinates."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, COORDINATES) for i in (4, 5))
                same = (x == y).sum(1)
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(same), *batch.columns[2:4]], names).filter(pa.array(same >= least))

    names = ["a", "b", "matches", "n_a", "n_b"]
    x = classes.select(F.col("cls").alias("a"), F.col("sig").alias("sig_a"), F.col("n_shingles").alias("n_a"))
    y = classes.select(F.col("cls").alias("b"), F.col("sig").alias("sig_b"), F.col("n_shingles").alias("n_b"))
    both = pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "n_a", "n_b", "sig_a", "sig_b")
    return both.mapInArrow(run, "a long, b long, matches long, n_a long, n_b long")


def may_link(pairs: DataFrame) -> DataFrame:
    """Pairs with enough collisions whose sizes allow a link."""
    return pairs.where((F.col("matches") >= MATCHES) & (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * SIMILAR_PERCENT))


def class_sets(docs: DataFrame, wanted: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """cls, shingles (binary) of the wanted (cls, rep) classes, made from the text of one document each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                sets = list(shingle_sets(part.column(1), n))
                keep = [s.tobytes() if set_hash(s) == c else None for s, c in zip(sets, part.column(0).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keep, pa.binary())], ["cls", "shingles"])

    # ids may be null or occur with several texts: the text's hash tells them apart
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key"))
    rows = texts.join(wanted.select("cls", "rep", "rep_key"), F.col("id").eqNullSafe(F.col("rep")) & (F.col("key") == F.col("rep_key")))
    return rows.select("cls", "text").mapInArrow(run, "cls long, shingles binary").where("shingles is not null").dropDuplicates(["cls"])


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with 100 * |both| >= SIMILAR_PERCENT * |either| on the full sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= SIMILAR_PERCENT * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return with_sets(pairs, sets).mapInArrow(run, "a long, b long")


def with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    x, y = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y"))
    return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y")


def differences(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, n_a, only): the size of a's set and the sorted shingles that only one of a and its pivot b has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, only = [], []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                size.append(len(x))
                only.append(np.setxor1d(x, y, assume_unique=True).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(size, pa.int64()), pa.array(only, pa.binary())], ["a", "b", "n_a", "only"])

    return with_sets(pairs, sets).mapInArrow(run, "a long, b long, n_a long, only binary")


def forest(i: np.ndarray, j: np.ndarray, m: int) -> np.ndarray:
    """The smallest number in each one's component, of links between numbers below m."""
    label = np.arange(m)
    while len(i):
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while (label[label] != label).any():
            label = label[label]
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
    return label


def tile_links(n: np.ndarray, loose: np.ndarray, only: list[np.ndarray], side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a spanning forest of them) among one pivot's members in a tile: between the members of
    side 0 and those of side 1, or among all if there is one side only.

    x and y differ in |D_x| + |D_y| - 2 |D_x and D_y| shingles, D being what only one of a member and the
    pivot has; the common parts are products of 0/1 matrices over the elements that several members share."""
    d = np.array([len(o) for o in only], np.int64)
    rows, cols = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if (side == 1).any() else (np.arange(len(n)), np.arange(len(n)))
    value, owner = np.concatenate(only), np.repeat(np.arange(len(n)), d)
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    new = np.append(True, value[1:] != value[:-1]) if len(value) else np.zeros(0, bool)
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1 if len(value) else np.zeros(0, bool)
    number = np.cumsum(shared) - 1
    keep = shared[column] if len(value) else new
    column, owner = number[column[keep]], owner[keep]
    common = np.zeros((len(rows), len(cols)), np.float32)
    cuts = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + TILE_COLUMNS, TILE_COLUMNS))
    for x, y in zip(cuts, cuts[1:]):
        if x < y:
            part = np.zeros((len(n), TILE_COLUMNS), np.float32)
            part[owner[x:y], column[x:y] % TILE_COLUMNS] = 1
            common += part[rows] @ part[cols].T
    apart = d[rows][:, None] + d[cols][None, :] - 2 * common.astype(np.int64)
    both = n[rows][:, None] + n[cols][None, :]
    linked = ((100 + SIMILAR_PERCENT) * apart <= (100 - SIMILAR_PERCENT) * both) & (loose[rows][:, None] | loose[cols][None, :])
    i, j = np.nonzero(linked)
    i, j = rows[i], cols[j]
    label = forest(i[i != j], j[i != j], len(n))
    own = np.flatnonzero(label != np.arange(len(n)))
    return own, label[own]


def by_tile(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], fn) -> Iterator[pa.RecordBatch]:
    """``fn`` of runs of whole tiles, of sorted rows whose tile is told by the columns ``names``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < TILE_MEMBERS:
            continue
        table = pa.Table.from_batches(held)
        keys = np.stack([table.column(c).to_numpy() for c in names])
        other = np.flatnonzero((keys[:, :-1] != keys[:, -1:]).any(0))
        if len(other):
            end = int(other[-1]) + 1
            yield from fn(table.slice(0, end))
            held = table.slice(end).to_batches()
    if held:
        yield from fn(pa.Table.from_batches(held))
    release()


def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) links of rows (pivot, ti, tj, block, a, loose, n_a, only) that are sorted by tile."""
    def links(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = np.stack([rows.column(c).to_numpy() for c in ("pivot", "ti", "tj")])
        cuts = [*np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(0))).tolist(), rows.num_rows]
        a, n = rows.column("a").to_numpy(), rows.column("n_a").to_numpy()
        loose, block = rows.column("loose").to_numpy(), rows.column("block").to_numpy()
        only = [np.frombuffer(v.as_buffer(), np.uint64) for v in rows.column("only")]
        for x, y in zip(cuts, cuts[1:]):
            if loose[x:y].any():
                u, v = tile_links(n[x:y], loose[x:y], only[x:y], (block[x:y] != keys[1, x]).astype(int))
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(a[x:y][u]), pa.array(a[x:y][v])], ["a", "b"])

    yield from by_tile(batches, ("pivot", "ti", "tj"), links)


def around_pivots(pivots: DataFrame, links: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that join the components of members of one pivot, at least one of them not linked with the pivot.

    Members that are both linked with the pivot are of one component anyway. Members are
    compared in tiles: a pivot's members are dealt in blocks of at most ``TILE_MEMBERS`` members and
    ``TILE_BYTES`` bytes, about, and each two blocks are compared as matrices. A tile returns a spanning forest
    of its links, a row a member at most, never its pairs."""
    linked = links.select("a", "b").withColumn("linked", F.lit(True))
    members = pivots.join(linked, ["a", "b"], "left").select("a", "b", F.coalesce("linked", F.lit(False)).alias("linked"))
    several = members.groupBy("b").agg(F.count("*").alias("m"), F.min("linked").alias("all_linked")).where("m > 1 AND NOT all_linked")
    members = materialize(members.join(several.select("b"), "b", "left_semi"), "pivot-members")
    with small_batches(pivots.sparkSession):
        own = materialize(differences(members.select("a", "b"), sets), "differences").join(members, ["a", "b"])
    blocks = own.groupBy("b").agg(F.greatest(F.ceil(F.count("*") / TILE_MEMBERS), F.ceil(F.sum(F.octet_length("only")) / TILE_BYTES)).cast("int").alias("blocks"))
    dealt = own.join(blocks, "b").withColumn("block", F.pmod(F.xxhash64("a", F.lit(3)), F.col("blocks")).cast("int"))
    tile = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tile = tile.select(F.col("b").alias("pivot"), F.least("block", "other").alias("ti"), F.greatest("block", "other").alias("tj"), "block", "a",
                       (~F.col("linked")).alias("loose"), "n_a", "only")
    tasks = max(pivots.sparkSession.sparkContext.defaultParallelism, partitions_for(pivots))
    return tile.repartition(tasks, "pivot", "ti", "tj").sortWithinPartitions("pivot", "ti", "tj").mapInArrow(tiled, "a long, b long")


def matching(sig: np.ndarray, n: np.ndarray, cls: np.ndarray, root: np.ndarray, pivot: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs in a tile of a list (of side 0 and side 1, or all if there is one side only) that no earlier step has
    settled, whose signatures agree in ``MATCHES`` coordinates and whose sizes allow a link."""
    two, out = bool((side == 1).any()), ([], [])
    for i in range(len(cls) - 1):
        rest = np.arange(i + 1, len(cls))
        ask = (root[rest] != root[i]) & (pivot[rest] != pivot[i]) & (cls[rest] != pivot[i]) & (pivot[rest] != cls[i])
        ask &= (np.minimum(n[rest], n[i]) * 100 >= np.maximum(n[rest], n[i]) * SIMILAR_PERCENT) & (not two or side[rest] != side[i])
        rest = rest[ask]
        rest = rest[(sig[rest] == sig[i]).sum(1) >= MATCHES]
        out[0].append(np.full(len(rest), i))
        out[1].append(rest)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) pairs of rows (key, ti, tj, block, cls, root, pivot, n_shingles, sig) that are sorted by tile."""
    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        c = {name: rows.column(name).to_numpy() for name in ("key", "ti", "tj", "block", "cls", "root", "pivot", "n_shingles")}
        keys = np.stack([c["key"], c["ti"], c["tj"]])
        cuts = [*np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(0))).tolist(), rows.num_rows]
        sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint32).reshape(-1, COORDINATES)
        for x, y in zip(cuts, cuts[1:]):
            own = slice(x, y)
            i, j = matching(sig[own], c["n_shingles"][own], c["cls"][own], c["root"][own], c["pivot"][own], (c["block"][own] != c["ti"][x]).astype(int))
            if len(i):
                one, other = c["cls"][own][i], c["cls"][own][j]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(one, other)), pa.array(np.minimum(one, other))], ["a", "b"])

    yield from by_tile(batches, ("key", "ti", "tj"), pairs)


def list_pairs(placed: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of members of one list with different components and pivots that may be linked, by comparing
    signatures in tiles: only pairs with enough collisions leave a tile."""
    mixed_lists = placed.groupBy("key").agg(F.count("*").alias("m"), F.min("pivot").alias("p"), F.max("pivot").alias("q"), F.min("root").alias("r"), F.max("root").alias("s"))
    mixed_lists = mixed_lists.where("p <> q AND r <> s").select("key", F.ceil(F.col("m") / TILE_MEMBERS).cast("int").alias("blocks"))
    rows = placed.join(mixed_lists, "key").join(classes.select("cls", "n_shingles", "sig"), "cls")
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("cls", F.lit(7)), F.col("blocks")).cast("int"))
    tile = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tile = tile.select("key", F.least("block", "other").alias("ti"), F.greatest("block", "other").alias("tj"), "block", "cls", "root", "pivot", "n_shingles", "sig")
    tasks = max(placed.sparkSession.sparkContext.defaultParallelism, partitions_for(placed))
    return tile.repartition(tasks, "key", "ti", "tj").sortWithinPartitions("key", "ti", "tj").mapInArrow(matched, "a long, b long")


def groups(docs: DataFrame, n: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The written signatures (id, n_shingles, cls), and cls, rep, root, component_id of every class."""
    with small_batches(docs.sparkSession, 2000):
        signed = materialize(signatures(docs, n, id_col, text_col), "signatures")
    smallest = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key")).alias("k")
    classes = materialize(signed.where("n_shingles > 0").groupBy("cls").agg(
        smallest, F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
        .select("cls", F.col("k.id").alias("rep"), F.col("k.text_key").alias("rep_key"), "n_shingles", "sig"), "classes")
    lists = materialize(merged_prefixes(classes), "lists")

    sets = lambda pairs, name: materialize(class_sets(docs, classes.join(
        pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "cls", "left_semi"), n, id_col, text_col), name)

    # 1: every member of a list with the member in the list's middle, its pivot
    heads = (lists.groupBy("key").agg(F.max(F.struct("score", "cls")).alias("head"), F.count("*").alias("m"))
             .where("m > 1").select("key", F.col("head.cls").alias("b"), F.col("head.score").alias("score")))
    stars = lists.join(heads, "key").where("cls <> b").select(F.col("cls").alias("a"), "b").distinct()
    stars = materialize(collisions(stars, classes, PIVOT_MATCHES), "star-pairs")
    # of the heads that a class meets, the one that most have in common: a group gets one pivot
    standing = heads.select("b", "score").distinct()
    pivots = materialize(stars.join(standing, "b").groupBy("a").agg(F.max(F.struct("score", "b")).alias("k"))
                         .select("a", F.col("k.b").alias("b")), "pivots")
    star_sets = sets(may_link(stars).select("a", "b").union(pivots), "star-sets")
    spark = docs.sparkSession
    with small_batches(spark):
        links = materialize(confirmed(may_link(stars), star_sets), "star-links")

    # 2: members of one pivot by their differences from it
    with small_batches(spark):
        links = materialize(links.union(around_pivots(pivots, links, star_sets)), "pivot-links")
    first = components(links)

    # 3: members of a list with those of other components and pivots
    of_pivot = pivots.select(F.col("a").alias("cls"), F.col("b").alias("pivot"))
    placed = materialize(lists.select("key", "cls").join(first.withColumnRenamed("node", "cls"), "cls", "left").join(of_pivot, "cls", "left")
                         .select("key", "cls", F.coalesce("root", "cls").alias("root"), F.coalesce("pivot", "cls").alias("pivot")), "placed")
    with small_batches(spark):
        cross = materialize(list_pairs(placed, classes).distinct(), "cross-pairs")
    cross_sets = sets(cross, "cross-sets")
    with small_batches(spark):
        cross_links = materialize(confirmed(cross, cross_sets), "cross-links")

    roots = components(links.union(cross_links)).withColumnRenamed("node", "cls")
    placed_classes = classes.select("cls", "rep").join(roots, "cls", "left").select("cls", "rep", F.coalesce("root", "cls").alias("root"))
    ids = placed_classes.groupBy("root").agg(F.min("rep").alias("component_id"))
    return signed.select("id", "n_shingles", "cls"), placed_classes.join(ids, "root")


def near_duplicates(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: id, n_shingles, component_id, kept (the id is its component's)."""
    signed, classes = groups(docs, n, id_col, text_col)
    out = (signed.withColumn("cls", F.when(F.col("n_shingles") > 0, F.col("cls")))
           .join(classes.select("cls", "component_id"), "cls", "left"))
    component = F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("id") == component, component.isNull()).alias("kept"))


def deduplicated(docs: DataFrame, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with one row of each component: one with its smallest id (null is the largest).

    Rows without shingles stay. Of rows that agree in id and shingle set one stays."""
    signed, classes = groups(docs, n, id_col, text_col)
    first = classes.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), F.col("rep"), F.col("cls"))).alias("k"))
    chosen = first.select(F.col("k.cls").alias("__cls"), F.col("k.rep").alias("__rep"))
    copies = (signed.join(chosen, [signed.cls == chosen.__cls, signed.id.eqNullSafe(chosen.__rep)], "left_semi")
              .where("n_shingles > 0").groupBy("cls").agg(F.count("*").alias("__copies")).withColumnRenamed("cls", "__cls"))
    chosen = chosen.join(copies, "__cls")

    @F.arrow_udf(LongType())
    def class_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in batches:
            yield pa.array([set_hash(s) if len(s) else None for s in shingle_sets(text, n)], pa.int64())
        release()

    # only the text goes to Python
    tagged = docs.withColumn("__set", class_of(F.col(f"`{text_col}`")))
    found = tagged.join(chosen, [tagged.__set == chosen.__cls, tagged[f"`{id_col}`"].eqNullSafe(chosen.__rep)], "left")
    kept = [F.col(f"`{c}`") for c in docs.columns]
    single = found.where("__set is null or __copies = 1").select(*kept)
    several = found.where("__copies > 1").dropDuplicates(["__set"]).select(*kept)
    return single.union(several)
