"""Spelling variants by dense prefix-suffix tiling.

Two words are near if one inserted, deleted or replaced code point turns one into
the other: exactly if their common prefix and common suffix together reach the
longer length less one. Groups of words are laid out as padded code-point matrices,
forwards and backwards; block pairs of rows are compared in whole-matrix steps
that give both lengths for every pair. A pair leaves nothing behind but a count and
the best near word of each side, so a group of m words returns at most m rows.

Which words meet: the free middle of a pair of longer length L (all of it at first)
is cut in two, and a pair shares either the first part of it or the last, by its common
prefix. So a word is put under a prefix key and a suffix key for L equal to its own
length and to one more, and every near pair is found under exactly one key. A key under
which more than ``GROUP`` words meet is cut again in the middle of what is still free,
in as many rounds as there are such keys; the last keys leave one code point free, and
all their words are near each other. Nothing is capped: a group that can't be cut any
more is compared block by block.

Defined results: a null text has no words, an empty table no rows; a null id counts
as an empty string in the digest; repeated rows count again; other columns
are ignored. Words need ``min_length`` code points and ``min_count`` occurrences. A
word's form is its near word of largest n (ties: the smallest in code-point order), if
that n is at least ``ratio`` times its own; roots follow forms by pointer doubling,
whose rounds are bounded by log2 of the longest chain, itself below log_ratio(largest n).
Memory is bounded by a task's table of distinct words (``HELD``), one text and
a block pair.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefspark.llm.tables import discard, materialize

RUN = re.compile("[A-Za-z\u00C0-\u00FF]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
ONE_IN = 199                 # runs of which a code point is deleted
MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
GROUP = 512                  # words under a key before it is cut again
HELD = 200_000               # distinct words a task holds before it sends their counts
TILE_CELLS = 4 << 20         # code points of a compared tile
ROWS_A_TASK = 100_000
STATE = ["lb", "a", "b", "hi", "key"]


def run_counts(key: str, text: bytes) -> Iterator[tuple[str, int]]:
    """Lower-cased runs of a text with their numbers; one in 199 (by digest of id and run) without a code point."""
    start = zlib.crc32(f"{key}:".encode())
    for run, n in Counter(RUN.findall(text.translate(LOWER).decode())).items():
        h = zlib.crc32(run.encode(), start)
        if h % ONE_IN == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        yield run, n


def contract_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of whole texts: counted in every task first, then over the corpus."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                for word, n in run_counts(key, text.as_py()):
                    if len(word) >= min_length:
                        held[word] += n
                if len(held) >= HELD:
                    yield sent()
                    held.clear()
        yield sent()

    rows = docs.where(F.col(f"`{text_col}`").isNotNull()).select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.col(f"`{text_col}`"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# ---------------------------------------------------------------- keys


def key_of(state):
    """Words with their shared first ``a`` and last ``b`` code points as a hash; whole words are compared later."""
    return state.withColumn("key", F.expr("xxhash64(left(word, a), right(word, b))"))


def first_keys(words: DataFrame) -> DataFrame:
    """Prefix and suffix keys for the own length and for one more."""
    rows = words.withColumn("len", F.length("word")).withColumn("lb", F.explode(F.array("len", F.col("len") + 1)))
    return key_of(rows.withColumn("s", F.expr("""explode(array(
        named_struct('a', lb div 2, 'b', 0L, 'hi', lb + 1L), named_struct('a', 0L, 'b', lb - lb div 2, 'hi', lb div 2)))"""))
        .selectExpr("word", "n", "len", "lb", "s.a", "s.b", "s.hi"))


def cut_keys(hot: DataFrame) -> DataFrame:
    """The same words under two keys each, the free middle cut in two."""
    rows = hot.withColumn("free", F.expr("lb - a - b")).withColumn("s", F.expr("""explode(filter(array(
        named_struct('a', a + free div 2, 'b', b, 'hi', hi),
        named_struct('a', a, 'b', b + free - free div 2, 'hi', least(hi, a + free div 2))), s -> s.a < s.hi))"""))
    return key_of(rows.selectExpr("word", "n", "len", "lb", "s.a", "s.b", "s.hi"))


def candidate_groups(words: DataFrame, group: int) -> DataFrame:
    """Rows (word, n, len, state) of all groups that are to be compared, hot keys cut until none is left."""
    rows, leaves = first_keys(words), None
    while True:
        sizes = rows.groupBy(*STATE).agg(F.count("*").alias("m"), F.max("len").alias("longest")).where("m > 1 AND longest = lb")
        met = materialize(rows.join(sizes, STATE).drop("longest"), "spelling-keys")
        cuttable = (F.col("m") > group) & (F.col("lb") - F.col("a") - F.col("b") > 1)
        leaves = met.where(~cuttable) if leaves is None else leaves.union(met.where(~cuttable))
        hot = met.where(cuttable)
        if hot.isEmpty():
            return leaves
        rows = cut_keys(hot)


# ---------------------------------------------------------------- tiles


def matrices(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, and of the words backwards, padded to ``width``."""
    def matrix(some: list[str]) -> np.ndarray:
        m = np.array(some, f"<U{width}").view(np.uint32).reshape(len(some), width)
        return m.astype(np.uint8) if m.max() < 256 else m

    return matrix(words), matrix([w[::-1] for w in words])


def common(m: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the common prefix of row pairs; equal rows count their whole width."""
    differ = m[i] != m[j]
    return np.where(differ.any(1), differ.argmax(1), m.shape[1])


class Best:
    """Near-word count and best near word of each row of a buffer."""

    def __init__(self, n: np.ndarray, rank: np.ndarray):
        self.n, self.rank = n, rank
        self.near, self.best = np.zeros(len(n), np.int64), np.full(len(n), -1, np.int64)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Row pairs that are near, both ways."""
        one, other = np.concatenate([i, j]), np.concatenate([j, i])
        self.near += np.bincount(one, minlength=len(self.near))
        order = np.lexsort((self.rank[other], -self.n[other], one))
        one, other = one[order], other[order]
        first = np.flatnonzero(np.diff(one, prepend=-1))
        one, other = one[first], other[first]
        old = self.best[one]
        better = (old < 0) | (self.n[other] > self.n[old]) | (self.n[other] == self.n[old]) & (self.rank[other] < self.rank[old])
        self.best[one[better]] = other[better]


def tiles(starts: np.ndarray, ends: np.ndarray, cells: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of groups of consecutive rows: many small groups together, large ones by block pairs."""
    side = max(1, int(cells**0.5))
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for s, e in zip(starts.tolist(), ends.tolist()):
        for x in range(s, e, side):
            for y in range(x, e, side):
                i, j = np.meshgrid(np.arange(x, min(e, x + side)), np.arange(y, min(e, y + side)), indexing="ij")
                i, j = (i[i < j], j[i < j]) if x == y else (i.ravel(), j.ravel())
                held.append((i, j))
                size += len(i)
                if size >= cells:
                    yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                    held, size = [], 0
    if size:
        yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])


def compare(rows: pa.Table) -> pa.RecordBatch | None:
    """(word, n_near, form_n, form) of sorted rows that hold whole groups of one longer length."""
    state = np.stack([rows.column(c).to_numpy() for c in STATE])
    cuts = np.flatnonzero(np.append(True, (state[:, 1:] != state[:, :-1]).any(0)))
    lb, a, hi = int(state[0, 0]), state[1], state[3]
    words = rows.column("word").to_pylist()
    n, length = rows.column("n").to_numpy(), rows.column("len").to_numpy()
    forward, backward = matrices(words, lb)
    best = Best(n, np.unique(np.array(words), return_inverse=True)[1])
    for i, j in tiles(cuts, np.append(cuts[1:], len(words)), max(1, TILE_CELLS // lb)):
        long_enough = np.maximum(length[i], length[j]) == lb
        i, j = i[long_enough], j[long_enough]
        prefix = common(forward, i, j)
        near = (prefix >= a[i]) & (prefix < hi[i])
        i, j, prefix = i[near], j[near], prefix[near]
        near = prefix + common(backward, i, j) >= lb - 1
        best.add(i[near], j[near])
    hit = np.flatnonzero(best.near)
    if not len(hit):
        return None
    names = np.array(words, object)
    return pa.RecordBatch.from_arrays([pa.array(names[hit], pa.string()), pa.array(best.near[hit]), pa.array(n[best.best[hit]]),
                                       pa.array(names[best.best[hit]], pa.string())], ["word", "n_near", "form_n", "form"])


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows in runs of whole groups of one longer length."""
    held: list[pa.RecordBatch] = []

    def whole(table: pa.Table) -> Iterator[pa.RecordBatch]:
        lbs = table.column("lb").to_numpy()
        cuts = [*np.flatnonzero(np.diff(lbs, prepend=-1)).tolist(), len(lbs)]
        for x, y in zip(cuts, cuts[1:]):
            if (got := compare(table.slice(x, y - x))) is not None:
                yield got

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < 2 * GROUP:
            continue
        table = pa.Table.from_batches(held)
        last = np.stack([table.column(c).to_numpy() for c in STATE])
        other = np.flatnonzero((last[:, :-1] != last[:, -1:]).any(0))
        if not len(other):
            continue                                          # one group so far
        end = int(other[-1]) + 1
        yield from whole(table.slice(0, end))
        held = table.slice(end).to_batches()
    if held:
        yield from whole(pa.Table.from_batches(held))


# ---------------------------------------------------------------- forms


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form) rows: the last word on the way along forms, by pointer doubling."""
    step = materialize(forms.withColumnRenamed("form", "root"), "spelling-roots")
    while True:
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = materialize(step.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        discard(step)
        step = new.select("word", "root")
        if new.where("moved").isEmpty():
            return step


def spelling_forms(words: DataFrame, ratio: int = RATIO, group: int = GROUP) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every (word, n) row; words are distinct."""
    spark = words.sparkSession
    words = materialize(words.select("word", "n"), "spelling-words")
    rows = candidate_groups(words, group)
    tasks = max(spark.sparkContext.defaultParallelism, -(-rows.count() // ROWS_A_TASK))
    hits = (rows.select("word", "n", "len", *STATE).repartition(tasks, *STATE).sortWithinPartitions(*STATE)
            .mapInArrow(compared, "word string, n_near long, form_n long, form string"))
    near = hits.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("m"), "form")).alias("top"))
    enough = -F.col("top.m") >= ratio * F.col("n")
    joined = materialize(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(enough, F.col("top.form")).alias("form"), F.when(enough, -F.col("top.m")).alias("form_n")), "spelling-near")
    last = roots(joined.where("form IS NOT NULL").select("word", "form"))
    return joined.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
