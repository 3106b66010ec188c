"""Models against naive forms, whole queries against the library, rows with odd ids and column names."""

import hashlib
import itertools
import math

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

import __spark_entry__ as E
import corpus_pipeline as cp
from prefspark.llm import decontaminate, language, minhash, toxicity

SF = "/root/testdata/sf0.001"


def test_items_with_one_id_or_none_are_searched_apart(spark, docs_of):
    a, b = "alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight nine"
    items = spark.createDataFrame([(10, a), (10, b), (10, a), (None, "red green blue black white"), (11, a), (12, "too short")], "item_id long, text string")
    docs = [(1, f"x {a} y"), (2, f"x {b} y"), (3, f"{a} and {b}"), (4, "Red green, blue black white!"), (5, " ".join(a.split()[:7]))]
    got = {(r.doc_id, r.item_id): (r.n_item, r.n_found) for r in decontaminate.contained_items(docs_of(docs), items).collect()}
    assert got == {(1, 10): (4, 4), (1, 11): (4, 4), (2, 10): (5, 5), (3, 10): (5, 5), (3, 11): (4, 4), (4, None): (1, 1)}


def test_column_names_with_dots(spark):
    rows = [(k, "a plain text of some words that repeat", "en", "s", 3, k) for k in range(4)] + [(9, "another text of quite other words", "en", "s", 3, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `m.k` long")
    labels = spark.createDataFrame([(0, 0), (9, 0)], "doc_id long, toxic int")
    assert toxicity.clean(docs, toxicity.train(docs, labels)).columns == docs.columns
    got = minhash.deduplicated(docs)
    assert got.columns == docs.columns and sorted(r[5] for r in got.collect()) == [0, 9]
    for _, stage in cp.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() > 0


def test_factorization_machine_equals_pair_sums():
    rng = np.random.default_rng(3)
    known = np.full(1 << toxicity.BITS, -1, np.int64)
    known[:50] = rng.permutation(50)
    fm = toxicity.FactorizationMachine(known, 0.3, rng.normal(size=50), rng.normal(size=(50, toxicity.FACTORS)))
    sets = [rng.choice(80, size=k, replace=False) for k in (0, 1, 2, 7, 30)]
    first = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    got = fm.score(np.concatenate(sets).astype(np.int64), first)
    for s, g in zip(sets, got):
        rows = [known[t] for t in s if known[t] >= 0]
        margin = 0.3 + sum(fm.linear[r] for r in rows) + sum(float(fm.factors[x] @ fm.factors[y]) for x, y in itertools.combinations(rows, 2))
        assert abs(g - 1 / (1 + math.exp(-margin))) < 1e-9


def test_the_training_sample_follows_no_layout(spark, docs_of, monkeypatch):
    monkeypatch.setattr(toxicity, "fit", lambda rows: sorted((bytes(t.astype(np.int32)), y) for t, y in rows))
    docs = docs_of([(k, f"word{k} and word{k % 7}") for k in range(900)] + [(5, "a second row of five")] * 3)
    labels = spark.createDataFrame([(k, k % 2) for k in range(900)], "doc_id long, toxic int")
    one = toxicity.train(docs.coalesce(1), labels.coalesce(1), most=100)
    assert one == toxicity.train(docs.repartition(13), labels.repartition(5), most=100) and 90 <= len(one) <= 104


def naive_gru(net, data, d):
    """One byte, one unit at a time."""
    p, h = net.p, net.h
    s, out = np.zeros(h), {}
    sig = lambda x: 1 / (1 + math.exp(-x))
    for t in range(len(data)) if d == "f" else reversed(range(len(data))):
        x = [float(p[f"in_{d}"][data[t], u]) + float(p[f"off_{d}"][u, 0]) for u in range(3 * h)]
        z = [sig(x[u] + sum(float(p[f"rec_{d}"][u, v]) * s[v] for v in range(h))) for u in range(h)]
        r = [sig(x[h + u] + sum(float(p[f"rec_{d}"][h + u, v]) * s[v] for v in range(h))) for u in range(h)]
        c = [math.tanh(x[2 * h + u] + sum(float(p[f"rec_{d}"][2 * h + u, v]) * r[v] * s[v] for v in range(h))) for u in range(h)]
        s = np.array([s[u] + z[u] * (c[u] - s[u]) for u in range(h)])
        out[t] = s
    return [out[t] for t in range(len(data))]


def test_byte_network_equals_a_naive_forward_pass():
    net = language.ByteNetwork(["de", "en", "fr"], state=5, seed=2)
    texts = [b"a text of several windows " * 6, b"x", "größe".encode()]
    for text in texts:
        total = np.zeros(3)
        for a in range(0, len(text), language.WINDOW):
            piece = text[a: a + language.WINDOW]
            padded = piece + b"\0" * (language.WINDOW - len(piece))
            f, b = naive_gru(net, padded, "f"), naive_gru(net, padded, "b")
            for t in range(len(piece)):
                y = np.array([float(net.p["bias"][k, 0]) + sum(float(w) * v for w, v in zip(net.p["out"][k], [*f[t], *b[t]])) for k in range(3)])
                total += y - math.log(sum(math.exp(v) for v in y))
        logs, labels = net.pooled(*language.windows(np.frombuffer(text, np.uint8), np.array([0, len(text)])), 1)
        assert np.allclose(logs[0], total, rtol=1e-4) and labels.sum() == len(text)


def test_bpe_query_equals_the_library(spark):
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = E.queries()["op9_bpe_roundtrip"](spark, SF).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))
