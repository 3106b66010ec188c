"""Spelling variants and whitening against brute force, line dedup against SQL and brute force."""

import hashlib
import os
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "scripts"))

import __spark_entry__ as E
from oracle_check import duck, rows_of
from prefspark.llm import line_dedup, spelling, whitening

SF = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}

# ---------------------------------------------------------------- spelling


def brute_words(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_forms(words):
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {(w, form[w], root(w), words[w], len(near[w]), words.get(form[w])) for w in words}


def forms_of(df):
    return Counter((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def test_spelling_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = forms_of(E.queries()["op11_spelling_variants"](spark, SF))
    assert got == Counter(brute_forms(brute_words(rows))) and sum(got.values()) > 100


@pytest.mark.parametrize("group", [2, 7, 512])
def test_spelling_forms_with_cut_groups(spark, group):
    rng = random.Random(group)
    words = {"a" * k: 5 ** (k % 4) * 5 for k in range(6, 12)} | {"é" * 6: 1000, "x" * 300: 5, "x" * 299: 30, "x" * 150 + "y" + "x" * 149: 200}
    for base in ("abcdef", "banana", "aaaaab", "çédille", "mississippi"):
        for _ in range(60):
            w = list(base * rng.choice((1, 1, 2)))
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(w))
                w[at:at + rng.randrange(2)] = rng.choice("abcdefs")
            words["".join(w)] = rng.choice((5, 5, 6, 25, 30, 200, 2000))
    words = {w: n for w, n in words.items() if len(w) >= 6}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert forms_of(spelling.spelling_forms(df, group=group)) == Counter(brute_forms(words))


def test_hot_group_is_cut_and_returns_a_row_a_word(spark):
    words = {f"{'z' * 12}{k:05d}".translate({48 + d: 97 + d for d in range(10)}): 5 + k % 3 for k in range(3000)}
    df = spark.createDataFrame(list(words.items()), "word string, n long").cache()
    met = spelling.candidate_groups(df, 512)
    assert met.where("m > 512").count() == 0 and met.count() < 40 * len(words)
    got = {r.word: r.n_near for r in spelling.spelling_forms(df).collect()}
    rng = random.Random(3)
    for w in rng.sample(sorted(words), 40):
        assert got[w] == sum(one_edit(w, v) for v in words)


def test_spelling_edges(spark, docs_of):
    rows = [(1, None), (2, ""), (3, "Straße straße STRASSE " * 5), (None, "planet planet"), (None, "planet planet"), (4, "planet"), (5, "planed " * 400)]
    got = forms_of(spelling.spelling_forms(spelling.contract_words(docs_of(rows))))
    assert got == Counter(brute_forms(brute_words(rows))) and ("planed", None, "planed", 400, 1, None) in got
    empty = docs_of([(1, "x")]).where("false")
    assert spelling.spelling_forms(spelling.contract_words(empty)).collect() == []
    long = docs_of([(7, "planet planets " * 40_000 + "q" * 100_000)] * 5)
    assert forms_of(spelling.spelling_forms(spelling.contract_words(long))) == Counter(brute_forms(brute_words([(7, "planet planets " * 40_000)] * 5) | {"q" * 100_000: 5}))


# ---------------------------------------------------------------- lines


def brute_lines(rows):
    strip = " \t\n\v\f\r"
    keys = [(i, [x.strip(strip).translate(LOWER) for x in (t or "").split("\n")]) for i, t in rows]
    owner = {}
    for i, own in keys:
        for k in own:
            if len(k) >= 10:
                owner[k] = min(owner.get(k, i), i)
    out = []
    for (i, own), (_, t) in zip(keys, rows):
        kept = [x for x, k in zip((t or "").split("\n"), own) if len(k) < 10 or owner[k] == i]
        out.append((i, "\n".join(kept), len(own), len(own) - len(kept)))
    return Counter(out)


def lines_of(df):
    return Counter((r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in df.collect())


def test_line_query_equals_sql(spark):
    df = E.queries()["op12_line_dedup"](spark, SF)
    rel = duck(SF).sql(E.oracle_sql()["op12_line_dedup"])
    assert rows_of(df.columns, df.collect(), 9) == rows_of(rel.columns, rel.fetchall(), 9)


@pytest.mark.parametrize("shard_keys", [1 << 19, 64])
def test_lines_equal_brute_force(docs_of, monkeypatch, shard_keys):
    """Small shards make several of them, and slices for the one that holds the common line."""
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", shard_keys)
    rng = random.Random(5)
    pool = [f"{'L' if k % 2 else 'l'}ine number {k}" for k in range(60)] + ["short", "", "  \t", "ééééé", "é" * 9, "é" * 10]
    rows = [(i, "\n".join([" The common LINE\r", *(rng.choice("  \t") + rng.choice(pool) + rng.choice(" \r\x0b") for _ in range(rng.randrange(12)))])) for i in range(300)]
    rows += [(5, "The common line\nline number 3"), (400, None), (401, ""), (402, "\n\n"), (403, "x\n" * 20_000 + "the common line\nend of it all")]
    rng.shuffle(rows)
    docs = docs_of(rows).repartition(40)
    assert lines_of(line_dedup.drop_repeated_lines(docs)) == brute_lines(rows)


def test_line_edges(spark, docs_of):
    got = line_dedup.drop_repeated_lines(docs_of([(None, "one line of text"), (3, "One line of text "), (3, "one line of text\nx")]), keep=("block", "lang"))
    assert got.columns == ["doc_id", "block", "lang", "kept_text", "n_lines", "n_dropped"]
    assert lines_of(got) == Counter([(None, "one line of text", 1, 0), (3, "", 1, 1), (3, "x", 2, 1)])
    assert line_dedup.drop_repeated_lines(docs_of([(1, "x")]).where("false")).collect() == []
    clash = spark.createDataFrame([(1, "a line that repeats", 7, "p"), (2, "a line that repeats", 8, "q")], "doc_id long, text string, `h1.x` int, shard string")
    assert lines_of(line_dedup.drop_repeated_lines(clash, keep=("h1.x", "shard"))) == Counter([(1, "a line that repeats", 1, 0), (2, "", 1, 1)])


# ---------------------------------------------------------------- whitening


def brute_whiten(rows, k=4):
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    d = max((len(v) for _, v in good), default=0)
    x = [[int(np.floor(256 * float(c))) for c in v] + [0] * (d - len(v)) for _, v in good]
    distinct = sorted(set(map(tuple, x)))
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    a = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in distinct])
    _, sigma, vt = np.linalg.svd(a, full_matrices=False)      # more exact than the eigenvalues of a'a
    e, vec = sigma[:k] ** 2 / n, vt[:k].T
    y = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in x]) @ vec / np.sqrt(e)
    dev = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    return [i for i, _ in good], n, dev, y, e / (sigma**2).sum() * n


def compare_whitening(df, rows, k=4):
    ids, n, dev, y, share = brute_whiten(rows, k)
    got = {(r.vec_id, r.component): r for r in df.collect()}
    assert len(got) == len(ids) * y.shape[1]
    for c in range(y.shape[1]):
        mine = np.array([got[i, c + 1].whitened for i in ids])
        sign = np.sign(mine @ y[:, c])
        assert mine * sign == pytest.approx(y[:, c], rel=1e-7, abs=1e-7)
        assert all(got[i, c + 1].explained == pytest.approx(share[c], rel=1e-9) for i in ids)
    assert all(got[i, 1].n == n and int(got[i, 1].deviation) == v for i, v in zip(ids, dev))
    assert {r.identity_error for r in got.values()} == {next(iter(got.values())).identity_error} and next(iter(got.values())).identity_error < 1e-8


def test_whitening_query_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    df = E.queries()["op13_embedding_whitening"](spark, SF)
    assert dict(df.dtypes)["deviation"] == "bigint"
    compare_whitening(df, rows)


def test_whitening_of_ill_conditioned_and_repeated_rows(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(200, 8)) * 10.0 ** np.array([5, 4, 3, 2, 1, 0, 0, 0]) + 1e6
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(1000 + i, base[3].tolist()) for i in range(300)]
    rows += [(-1, None), (-2, [1.0, None] + [0.0] * 6), (-3, [float("nan")] * 8), (-4, [float("inf")] * 8), (-5, [1.0, 2.0]), (-6, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    compare_whitening(whitening.whiten(df, components=7), rows, 7)


def test_whitening_edges(spark):
    def make(rows):
        return spark.createDataFrame([(i, v, 1, "s") for i, v in rows], "vec_id long, embedding array<float>, x int, `i.v` string")
    assert whitening.whiten(make([(1, [1.0])]).where("false")).collect() == []
    assert whitening.whiten(make([(1, []), (2, None)])).collect() == []
    one = whitening.whiten(make([(1, [1.0, 2.0]), (None, [1.0, 2.0])])).collect()
    assert [(r.n, r.whitened, r.explained, r.identity_error, int(r.deviation)) for r in one] == [(1, None, 0.0, 0.0, 0)] * 4
    flat = whitening.whiten(make([(k, [k / 16, 5.0, k / 8]) for k in range(20)])).collect()
    assert len(flat) == 60 and all((r.whitened is None) == (r.component > 1) for r in flat)
    assert all(r.explained == pytest.approx(1.0 if r.component == 1 else 0.0, abs=1e-12) for r in flat)
    for size, deviation in ((1e16, (512 * 10**16) ** 2 + 256**2), (1e300, None)):      # beyond a long's range, and beyond 38 digits
        huge = whitening.whiten(spark.createDataFrame([(1, [size, 1.0]), (2, [-size, 2.0])], "vec_id long, embedding array<double>")).collect()
        assert {r.deviation for r in huge} == {deviation} and all(abs(r.whitened) == pytest.approx(1) for r in huge if r.component == 1)
