"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into windows of ``WINDOW`` bytes, every byte in one
window. A forward and a backward gated recurrent layer run over each window
(thousands of windows at once, as matrix columns); both states at a position give
a distribution over the languages, so every position has a label. A document's
probabilities are those of all its positions pooled (the mean of their logs,
normalized); its language is the most probable one.

The network is trained in numpy by backpropagation through time on at most
``SAMPLE_ROWS`` documents for each language outside the held-out fold, picked by a
hash of the id, from ``SAMPLE_WINDOWS`` windows of each at places drawn by a hash
over the whole text; only text and language of those rows are read. Prediction is one
pass over all whole texts without a shuffle.

Defined results: a null or empty text, or one without a letter, is ``und`` with
score 0; so is every text if nothing could be learned. Null languages and ids
teach nothing; ties go to the language that sorts first; repeated rows each give
a row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefspark.llm.tables import held_out, row_runs, text_buffers

WINDOW, STATE = 64, 8
SAMPLE_ROWS, SAMPLE_WINDOWS = 400, 3
EPOCHS, LEAST_STEPS, BATCH, RATE = 6, 120, 256, 0.01
COLUMNS = 2048
FOLDS, FOLD = 5, 0
UNKNOWN = "und"


def windows(raw: np.ndarray, offs: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size x n) bytes of all windows, their lengths and rows; a text's last window is filled up with zeros."""
    count = -(-np.diff(offs) // size)
    row = np.repeat(np.arange(len(count)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = offs[row] + nth * size
    length = np.minimum(size, offs[row + 1] - start)
    at = start + np.arange(size)[:, None]
    data = raw[np.minimum(at, max(0, len(raw) - 1))] if len(row) else np.zeros((size, 0), np.uint8)
    return np.where(np.arange(size)[:, None] < length, data, np.uint8(0)), length, row


class ByteNetwork:
    """Weights of both directions and of the output layer. Shapes: units x columns."""

    def __init__(self, languages: list[str], state: int = STATE, seed: int = 5):
        rng, h, k = np.random.default_rng(seed), state, len(languages)
        self.languages, self.h = languages, h
        self.p = {"out": rng.normal(0, 0.3, (k, 2 * h)), "bias": np.zeros((k, 1))}
        for d in "fb":      # update gate, reset gate, candidate, one below the other
            self.p[f"in_{d}"] = rng.normal(0, 0.3, (256, 3 * h))
            self.p[f"rec_{d}"] = rng.normal(0, 0.3, (3 * h, h))
            self.p[f"off_{d}"] = np.zeros((3 * h, 1))
        self.p = {n: w.astype(np.float32) for n, w in self.p.items()}

    def layer(self, data: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (steps x units x columns) of one direction; ``keep`` gets what the gradient needs."""
        p, h = self.p, self.h
        table = np.ascontiguousarray((p[f"in_{d}"] + p[f"off_{d}"].T).T)
        gates, cand = p[f"rec_{d}"][: 2 * h], p[f"rec_{d}"][2 * h:]
        steps, n = data.shape
        out = np.empty((steps, h, n), np.float32)
        s = np.zeros((h, n), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            x = table.take(data[t], axis=1)
            zr = gates @ s
            zr += x[: 2 * h]
            zr *= np.float32(0.5)
            np.tanh(zr, out=zr)         # logistic by way of tanh
            zr += np.float32(1)
            zr *= np.float32(0.5)
            z, r = zr[:h], zr[h:]
            rs = r * s
            c = cand @ rs
            c += x[2 * h:]
            np.tanh(c, out=c)
            if keep is not None:
                keep.append((t, s, z, r, rs, c))
            c2 = c - s
            c2 *= z
            c2 += s
            s = c2
            out[t] = s
        return out

    def log_probs(self, data: np.ndarray, fwd=None, bwd=None) -> np.ndarray:
        """(steps x languages x columns) log probabilities of every position."""
        fwd = self.layer(data, "f") if fwd is None else fwd
        bwd = self.layer(data, "b") if bwd is None else bwd
        y = self.p["out"][:, : self.h] @ fwd
        y += self.p["out"][:, self.h:] @ bwd
        y += self.p["bias"]
        y -= y.max(1, keepdims=True)
        y -= np.log(np.exp(y).sum(1, keepdims=True))
        return y

    def gradient(self, data: np.ndarray, length: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss over all positions, by backpropagation through time."""
        p, h, g = self.p, self.h, {n: np.zeros_like(w) for n, w in self.p.items()}
        kept = {"f": [], "b": []}
        states = {d: self.layer(data, d, kept[d]) for d in "fb"}
        e = np.exp(self.log_probs(data, states["f"], states["b"]))
        e[:, label, np.arange(len(label))] -= 1
        e *= (np.arange(len(data))[:, None] < length)[:, None, :] / np.float32(length.sum())
        g["bias"] = e.sum((0, 2))[:, None]
        for i, d in enumerate("fb"):
            cols = slice(i * h, (i + 1) * h)
            g["out"][:, cols] = np.einsum("tkn,thn->kh", e, states[d], optimize=True)
            gates, cand = p[f"rec_{d}"][: 2 * h], p[f"rec_{d}"][2 * h:]
            ds = np.zeros((h, data.shape[1]), np.float32)
            for t, s, z, r, rs, c in reversed(kept[d]):
                ds = ds + p["out"][:, cols].T @ e[t]
                dc = ds * z * (1 - c * c)
                dz = ds * (c - s) * z * (1 - z)
                drs = cand.T @ dc
                dr = drs * s * r * (1 - r)
                dzr = np.concatenate((dz, dr))
                g[f"rec_{d}"][: 2 * h] += dzr @ s.T
                g[f"rec_{d}"][2 * h:] += dc @ rs.T
                da = np.concatenate((dzr, dc))
                by = np.argsort(data[t], kind="stable")
                at = np.flatnonzero(np.diff(data[t][by].astype(np.int64), prepend=-1))
                g[f"in_{d}"][data[t][by][at]] += np.add.reduceat(da[:, by], at, axis=1).T
                g[f"off_{d}"] += da.sum(1, keepdims=True)
                ds = ds * (1 - z) + drs * r + gates.T @ dzr
        return g

    def pooled(self, data: np.ndarray, length: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Per row: summed log probabilities and the number of positions labelled with each language."""
        k = len(self.languages)
        logs, labels = np.zeros((rows, k)), np.zeros((rows, k), np.int64)
        for a in range(0, data.shape[1], COLUMNS):
            cut = slice(a, a + COLUMNS)
            y = self.log_probs(np.ascontiguousarray(data[:, cut]))
            real = np.arange(len(data))[:, None] < length[cut]
            best = y.argmax(1)
            y *= real[:, None, :]
            each = y.sum(0)
            for j in range(k):
                logs[:, j] += np.bincount(row[cut], each[j], rows)
                labels[:, j] += np.bincount(row[cut], ((best == j) & real).sum(0), rows).astype(np.int64)
        return logs, labels


def fit(texts: list[bytes], labels: list[str], epochs: int = EPOCHS, seed: int = 5) -> ByteNetwork | None:
    """Adam over the windows of the sample; a small sample is gone through more often."""
    languages = sorted(set(labels))
    if not languages:
        return None
    net, rng = ByteNetwork(languages, seed=seed), np.random.default_rng(seed)
    data, length, row = windows(np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64))
    if not data.shape[1]:
        return None
    label = np.array([languages.index(x) for x in labels])[row]
    (m, v), step = ({n: np.zeros_like(w) for n, w in net.p.items()} for _ in range(2)), 0
    for _ in range(max(epochs, min(40 * epochs, -(-LEAST_STEPS * BATCH // data.shape[1])))):
        order = rng.permutation(data.shape[1])
        for a in range(0, len(order), BATCH):
            pick = order[a: a + BATCH]
            step += 1
            for n, g in net.gradient(data[:, pick], length[pick], label[pick]).items():
                m[n] += 0.1 * (g - m[n])
                v[n] += 0.01 * (g * g - v[n])
                net.p[n] -= (RATE * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def train(docs: DataFrame, most: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteNetwork | None:
    """Fit on at most ``most`` documents for each language, ``SAMPLE_WINDOWS`` windows of each, outside the held-out fold."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        ~held_out("id", FOLDS, FOLD)).where("lang is not null")
    counts = {r.lang: r["count"] for r in own.groupBy("lang").count().collect()}       # a row for each language
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1 << 20, 2 * most * (1 << 20) // n))])
    mark = F.pmod(F.xxhash64("id", F.lit(23)), F.lit(1 << 20))
    picked = own.where(mark < share[F.col("lang")])
    # a training window from each third of a document, at a place drawn by a hash of the id: any byte can be learned from
    length = F.octet_length("text")
    drawn = [(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1 << 20)) / (1 << 20) + i) / SAMPLE_WINDOWS for i in range(SAMPLE_WINDOWS)]
    cuts = [F.substring(F.encode("text", "UTF-8"), (F.greatest(length - WINDOW + 1, F.lit(1)) * u).cast("int") + 1, WINDOW) for u in drawn]
    rows = sorted(picked.select("lang", "id", F.array(*cuts).alias("cuts"), mark.alias("mark")).where("text is not null")
                  .limit(4 * most * len(counts)).collect(), key=lambda r: (r.lang, r.mark, str(r.id)))
    texts, labels, taken = [], [], dict.fromkeys(counts, 0)
    for r in rows:
        if taken[r.lang] < most:
            taken[r.lang] += 1
            texts += [bytes(c) for c in dict.fromkeys(map(bytes, r.cuts)) if c]
            labels += [r.lang] * (len(texts) - len(labels))
    return fit(texts, labels)


def identify(docs: DataFrame, net: ByteNetwork | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score (pooled probability), n_positions and n_agree (positions labelled lang_pred)."""
    model = docs.sparkSession.sparkContext.broadcast(net)         # a few thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            raw, offs = text_buffers(batch.column(1))
            letters = batch.column(2).fill_null(False).to_numpy(zero_copy_only=False)
            n = batch.num_rows
            pred, score, agree = np.full(n, UNKNOWN, object), np.zeros(n), np.zeros(n, np.int64)
            for a, b in row_runs(offs, 1 << 20) if own else ():
                logs, labels = own.pooled(*windows(raw[offs[a]: offs[b]], offs[a: b + 1] - offs[a]), b - a)
                size = np.maximum(1, np.diff(offs[a: b + 1]))[:, None]
                probs = np.exp(logs / size)
                probs /= probs.sum(1, keepdims=True)
                best, line = probs.argmax(1), np.arange(b - a)
                known = letters[a:b]
                pred[a:b][known] = np.array(own.languages, object)[best][known]
                score[a:b][known] = probs[line, best][known]
                agree[a:b][known] = labels[line, best][known]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score),
                                              pa.array(np.diff(offs)), pa.array(agree)],
                                             [id_col, "lang_pred", "score", "n_positions", "n_agree"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).alias("__text"), F.col(text_col).rlike(r"\p{L}").alias("__letters")).mapInArrow(
        run, f"{id_col} {kind}, lang_pred string, score double, n_positions long, n_agree long")


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_positions, n_agree of every document."""
    got = identify(docs, train(docs))
    return got.select("doc_id", held_out("doc_id", FOLDS, FOLD).alias("held_out"), "lang_pred", "score", "n_positions", "n_agree")
