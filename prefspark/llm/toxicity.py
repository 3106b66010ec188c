"""Toxicity by a factorization machine over hashed terms.

A text is the set of its terms (runs of letters and digits, lower-cased),
hashed to ``2**BITS`` numbers. Its score is the logistic of a bias, the linear
weights of its terms and the inner products of their factors, summed over all
pairs of terms: two terms that are harmless apart can count together (an insult
and a group's name), which additive weights miss. The pair sum is linear in the
number of terms: half of (squared sum of factors - sum of squares).

Training takes at most ``SAMPLE_ROWS`` labelled ids outside the held-out fold, picked by a
hash of the id, and about twice as many of their rows at most, if ids are repeated; terms of fewer than ``LEAST_ROWS`` of them get no
weight. All others get factors, so a pair of terms that are each ordinary alone
can count; a linear weight only those whose share of toxic rows lies at least
``LEAST_LEAN`` standard errors from the sample's. The factors of the rest shrink
``NEUTRAL`` times as fast where the data doesn't hold them up. AdaGrad in numpy on
that bounded sample; scoring is one pass over all texts without a shuffle.

Defined results: null or empty text scores the bias alone; a document with
several labels counts as its highest, null labels and ids teach nothing; with
no labelled rows every score is 0; repeated rows each give a row; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from prefspark.llm.tables import held_out, release, row_runs, text_buffers
from prefspark.llm.words import NO_TERM, word_hashes

BITS, FACTORS = 18, 8
SAMPLE_ROWS = 16_000
LEAST_ROWS, LEAST_LEAN = 4, 3.0
EPOCHS, BATCH, RATE, DECAY, SPARSITY = 12, 256, 0.3, 2e-4, 1e-3
NEUTRAL, FACTOR_START = 5.0, 1e-2     # FACTOR_START: what the factors' squared gradients start at
FOLDS, FOLD = 5, 0


def batch_terms(col: pa.Array, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct term numbers of consecutive rows, and each row's first place in them."""
    raw, offs = text_buffers(col)
    for a, b in row_runs(offs, most):
        own = offs[a: b + 1] - offs[a]
        hashes, first = word_hashes(raw[offs[a]: offs[b]], own, NO_TERM)
        row = np.repeat(np.arange(b - a, dtype=np.uint64), np.diff(first))
        both = np.unique(row << np.uint64(32) | hashes >> np.uint64(64 - BITS))
        yield (both & np.uint64(2**32 - 1)).astype(np.int64), np.searchsorted(both >> np.uint64(32), np.arange(b - a + 1, dtype=np.uint64))


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of rows; an empty run sums to 0."""
    sums = np.concatenate((np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)))
    return sums[first[1:]] - sums[first[:-1]]


class FactorizationMachine:
    """bias, linear weights and factors of the terms; ``known`` maps a term number to its row."""

    def __init__(self, known: np.ndarray, bias: float, linear: np.ndarray, factors: np.ndarray):
        self.known, self.bias, self.linear, self.factors = known, bias, linear, factors

    def rows(self, terms: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the known terms only."""
        at = self.known[terms]
        keep = at >= 0
        return at[keep], np.concatenate(([0], np.cumsum(keep)))[first]

    def margin(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        v = self.factors[rows]
        both = row_sums(np.concatenate((self.linear[rows][:, None], v, v * v), axis=1), first)
        k = self.factors.shape[1]
        return self.bias + both[:, 0] + 0.5 * (both[:, 1: k + 1] ** 2 - both[:, k + 1:]).sum(1)

    def score(self, terms: np.ndarray, first: np.ndarray) -> np.ndarray:
        return logistic(self.margin(*self.rows(terms, first)))


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit(samples: list[tuple[np.ndarray, int]], seed: int = 7, epochs: int = EPOCHS) -> FactorizationMachine:
    """AdaGrad over (distinct term numbers, label) rows."""
    rng, labels = np.random.default_rng(seed), np.array([y for _, y in samples], np.float64)
    none = [np.zeros(0, np.int32)]
    df = np.bincount(np.concatenate([t for t, _ in samples] or none), minlength=1 << BITS)
    hits = np.bincount(np.concatenate([t for t, y in samples if y] or none), minlength=1 << BITS)
    rate = (labels.sum() + 0.5) / (len(labels) + 1)
    # how far a term's share of label 1 lies from the sample's, in standard errors
    lean = np.abs(hits - rate * df) / np.sqrt(rate * (1 - rate) * np.maximum(df, 1))
    used = np.flatnonzero((df >= min(LEAST_ROWS, max(1, len(samples) // 20))))
    leans = lean[used] >= LEAST_LEAN
    shrink = np.where(leans, SPARSITY, NEUTRAL * SPARSITY)[:, None]
    known = np.full(1 << BITS, -1, np.int64)
    known[used] = np.arange(len(used))
    if not len(samples):
        return FactorizationMachine(known, -60.0, np.zeros(0), np.zeros((0, FACTORS)))
    fm = FactorizationMachine(known, float(np.log(rate / (1 - rate))), np.zeros(len(used)), rng.normal(0, 0.02, (len(used), FACTORS)))
    heavy = np.sqrt((1 - rate) / rate)
    data = [at[at >= 0].astype(np.int32) for at in (known[t] for t, _ in samples)]
    g_bias, g_lin, g_fac = 1e-8, np.full(len(used), 1e-8), np.full((len(used), FACTORS), FACTOR_START)
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for a in range(0, len(order), BATCH):
            pick = order[a: a + BATCH]
            rows = np.concatenate([data[i] for i in pick])
            count = np.array([len(data[i]) for i in pick])
            first = np.concatenate(([0], np.cumsum(count)))
            err = (logistic(fm.margin(rows, first)) - labels[pick]) * np.where(labels[pick] == 1, heavy, 1) / len(pick)
            own = np.repeat(np.arange(len(pick)), count)
            v = fm.factors[rows]
            step = np.concatenate((np.ones((len(rows), 1)), row_sums(v, first)[own] - v), axis=1) * err[own][:, None]
            by = np.argsort(rows, kind="stable")
            at = np.flatnonzero(np.diff(rows[by], prepend=-1))
            if len(at):
                u, g = rows[by][at], np.add.reduceat(step[by], at, axis=0)
                gl, gv = g[:, 0], g[:, 1:] + DECAY * fm.factors[u]
                g_lin[u] += gl * gl
                g_fac[u] += gv * gv
                step_lin, step_fac = RATE / np.sqrt(g_lin[u]), 0.3 * RATE / np.sqrt(g_fac[u])
                w, v = fm.linear[u] - step_lin * gl, fm.factors[u] - step_fac * gv
                # proximal step: weights that the data doesn't hold up go to 0
                fm.linear[u] = np.sign(w) * np.maximum(0, np.abs(w) - step_lin * SPARSITY) * leans[u]
                size = np.sqrt((v * v).sum(1, keepdims=True)) + 1e-12
                fm.factors[u] = v * np.maximum(0, 1 - step_fac.mean(1, keepdims=True) * shrink[u] / size)
            g_bias += err.sum() ** 2
            fm.bias -= RATE * err.sum() / np.sqrt(g_bias)
    return fm


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id",
          text_col: str = "text", most: int = SAMPLE_ROWS) -> FactorizationMachine:
    """Fit on at most ``most`` labelled rows outside the held-out fold."""
    own = (labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where("id is not null and y is not null")
           .where(~held_out("id", FOLDS, FOLD)).groupBy("id").agg(F.max("y").cast("int").alias("y")))
    n = own.count()
    share = min(1.0, most / max(1, n))
    # a little more than ``most`` by hash, then the first ``most`` in the hash's order: the same rows in any layout
    drawn = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30))
    picked = own.withColumn("drawn", drawn).where(F.col("drawn") < int(min(1.0, 1.1 * share + 100 / max(1, n)) * (1 << 30)))
    picked = picked.orderBy("drawn", "id").limit(most).select("id", "y")
    # at most ``most`` narrow rows: a proven bound
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [t[x:y].astype(np.int32).tobytes() for t, f in batch_terms(batch.column(1)) for x, y in zip(f, f[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.binary()), batch.column(2)], ["id", "terms", "y"])

    id_type = sample.schema["id"].dataType.simpleString()
    # ids may occur in several rows, even in most of them: then rows are drawn by a hash of id and text
    several = docs.select(F.col(id_col).alias("id")).join(F.broadcast(picked.select("id")), "id").count()
    if several > 2 * most:
        sample = sample.where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) < int(2 * most / several * (1 << 30)))
    rows = sample.select("id", "text", "y").mapInArrow(run, f"id {id_type}, terms binary, y int").collect()
    rows.sort(key=lambda r: (r.id, bytes(r.terms)))        # the same order on every run
    samples = [(np.frombuffer(r.terms, np.int32), r.y) for r in rows]
    del rows
    model = fit(samples)
    del samples
    release()
    return model


def score(docs: DataFrame, fm: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text",
          keep: tuple[str, ...] = ()) -> DataFrame:
    """Score every row: the columns ``keep`` of the input, then score and predicted."""
    model = docs.sparkSession.sparkContext.broadcast(fm)      # at most 2**BITS rows of weights
    keep = keep or (id_col,)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            got = [model.value.score(t, f) for t, f in batch_terms(text)]
            values = np.concatenate(got) if got else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(values, pa.float64()), pa.array((values >= 0.5).astype(np.int32))],
                [*keep, "score", "predicted"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, f"{schema}, score double, predicted int")


def clean(docs: DataFrame, fm: FactorizationMachine, text_col: str = "text") -> DataFrame:
    """The rows of docs that are not predicted toxic."""
    model = docs.sparkSession.sparkContext.broadcast(fm)

    @F.arrow_udf(BooleanType())
    def harmless(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in batches:
            got = [model.value.score(t, f) for t, f in batch_terms(text)]
            yield pa.array(np.concatenate(got) < 0.5 if got else np.zeros(0, bool))
        release()

    return docs.where(harmless(F.col(f"`{text_col}`")))      # only the text goes to Python


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    got = score(docs, train(docs, labels))
    return got.select("doc_id", held_out("doc_id", FOLDS, FOLD).alias("held_out"), "score", "predicted")
