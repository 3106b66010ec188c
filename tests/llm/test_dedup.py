"""MinHash and embedding near-duplicates, repeats and decontamination against brute force and SQL."""

import hashlib
import itertools
import os
import random
import re
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "scripts"))

import __spark_entry__ as E
from oracle_check import duck, rows_of
from prefspark.llm import components as cc
from prefspark.llm import decontaminate, embeddings, minhash, repeats
from prefspark.llm.blocks import arrays, unpacked

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op1_minhash_dedup", "op2_decontaminate", "op7_chat_format", "op8_embedding_dedup"])
def test_query_equals_sql(spark, name):
    df = E.queries()[name](spark, SF)
    rel = duck(SF).sql(E.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(df.columns, df.collect(), 9) == rows_of(rel.columns, rel.fetchall(), 9)


def brute_components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in ids}


def shingles(text, n):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall("[^\x20\x09-\x0d]+", lower)
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def varied(rng, base, changes):
    words = base.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("n", [2, 5])
def test_minhash_equals_brute_force(docs_of, n):
    rng = random.Random(n)
    base = [" ".join(rng.choices([f"w{i}" for i in range(300)], k=k)) for k in (1, 2, 4, 6, 30, 60, 150, 400)]
    texts = [None, "", " \t\n", "One", "one", "one two", *base, *[b.upper() for b in base]]
    texts += [varied(rng, base[7], c) for c in (1, 2, 5, 8, 10, 12, 15, 20, 25, 40) for _ in range(3)]
    texts += [varied(rng, base[6], c) for c in (1, 2, 3, 4, 5, 6) for _ in range(3)]
    rows = [(100 - i, t) for i, t in enumerate(texts)]
    sets = {i: shingles(t, n) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2)
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = brute_components(sets, links)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs_of(rows), n).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {
        i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_minhash_hot_group_and_ties(docs_of):
    rng = random.Random(3)
    base = " ".join(f"word{i}" for i in range(300))
    rows = [(i, varied(rng, base, 4)) for i in range(150)] + [(1000 + i, base) for i in range(150)] + [(7, "a b c d e f g"), (7, "a b c d e f g"), (None, "a b c d e f g")]
    got = minhash.near_duplicates(docs_of(rows), 2).collect()
    assert len(got) == len(rows)
    assert {r.component_id for r in got if r.n_shingles > 20} == {0}
    assert [(r.component_id, r.kept) for r in got if r.n_shingles == 6 and r.doc_id == 7] == [(7, True)] * 2
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(7, False)]
    kept = minhash.deduplicated(docs_of(rows), 5)
    assert kept.columns == ["doc_id", "text", "lang", "block"]
    assert sorted(r.doc_id for r in kept.collect()) == [0, 7]


def test_minhash_empty_and_textless(spark, docs_of):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(empty, 2).collect() == []
    assert minhash.deduplicated(empty).collect() == []
    rows = [(1, None), (2, ""), (None, None), (3, None)]
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in minhash.near_duplicates(docs_of(rows), 2).collect()) == [
        (-1, -1, True), (1, 1, True), (2, 2, True), (3, 3, True)]
    assert minhash.deduplicated(docs_of(rows)).count() == 4


def test_components_of_random_graphs(spark):
    rng = random.Random(5)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(500 + i, 501 + i) for i in range(60)]
    want = brute_components({x for p in links for x in p}, links)
    got = {r.node: r.root for r in cc.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(i, i) == r for i, r in want.items())


def brute_repeats(rows):
    out, seen = {}, {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            w = b[k:k + 50]
            seen[w] = min(seen.get(w, i), i)
    for i, t in rows:
        b = (t or "").encode()
        cut = bytearray(len(b))
        for k in range(len(b) - 49):
            if seen[b[k:k + 50]] < i:
                cut[k:k + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(b)) if cut[k] and (k == 0 or not cut[k - 1]))
        out.setdefault(i, []).append((len(b), sum(cut), spans, hashlib.sha256(bytes(c for c, z in zip(b, cut) if not z)).hexdigest()))
    return {i: sorted(v) for i, v in out.items()}


def test_repeats_equal_brute_force(docs_of, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 1 << 10)
    rng = random.Random(9)
    pieces = ["".join(rng.choices("abcdé ß", k=rng.randrange(1, 140))) for _ in range(40)] + ["a" * 300, "ab" * 100, "日本" * 60]
    rows = [(rng.randrange(60), "".join(rng.choices(pieces, k=rng.randrange(0, 12)))) for _ in range(80)]
    rows += [(5, None), (6, ""), (61, "x" * 49), (62, "x" * 49), (63, "y" * 50), (64, "y" * 50), (64, "y" * 50)]
    got = {}
    for r in repeats.remove_repeats(docs_of(rows)).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    assert {i: sorted(v) for i, v in got.items()} == brute_repeats(rows)


def test_repeats_of_equal_ids_in_two_partitions(docs_of):
    rng = random.Random(5)
    passage = "".join(rng.choices("abcdefghij ", k=75))
    other = lambda: "".join(rng.choices("klmnopqrst ", k=120))
    fifth = other() + passage + other()
    rows = [(1, other() + passage + other()), (5, fifth), (5, fifth), (5, other() + fifth)]
    got = {}
    for r in repeats.remove_repeats(docs_of(rows).repartitionByRange(4, "text").union(docs_of([(5, fifth)]))).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    want = brute_repeats([*rows, (5, fifth)])
    assert {i: sorted(v) for i, v in got.items()} == want and min(w[1] for w in want[5]) >= 75


def test_suffix_ranks_follow_byte_order():
    rng = np.random.default_rng(4)
    rows = rng.choice(np.frombuffer(b"ab\xff\0", np.uint8), (200, repeats.WIDTH))
    rows[120:, :56] = rows[:80, :56]
    rows[:, repeats.LENGTH + repeats.SIDE - 1:] = 0
    strings = [r[j: j + repeats.LENGTH].tobytes() for r in rows for j in range(repeats.SIDE)]
    place = {v: i for i, v in enumerate(sorted(set(strings)))}
    assert repeats.suffix_ranks(rows).ravel().tolist() == [place[v] for v in strings]
    assert repeats.suffix_ranks(rows[:0]).shape == (0, repeats.SIDE)


def test_parts_cover_each_window_once_and_hold_their_anchor():
    raw = np.random.default_rng(2).integers(97, 101, 5000).astype(np.uint8)
    p = repeats.Parse(raw, np.array([0, 30, 2000, 2049, 5000]))
    _, begin, end, anchor = p.parts(np.arange(len(p.first)))
    covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(begin, end)])
    whole = [s for a, b in zip(p.offs[:-1], p.offs[1:]) for s in range(a, b - repeats.LENGTH + 1)]
    assert sorted(covered.tolist()) == whole
    assert (end - begin < repeats.SIDE).all() and (anchor >= end).all() and (anchor + repeats.ANCHOR <= begin + repeats.LENGTH).all()


def test_repeats_around_one_hot_string(docs_of, monkeypatch):
    monkeypatch.setattr(repeats, "SLICE", 8)
    rng = random.Random(3)
    hot = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=29))
    side = lambda: ["".join(rng.choices("xyz ", k=n)) for n in (5, 11, 21, 40)]
    left, right = side() + side(), side() + side()
    rows = [(rng.randrange(200), rng.choice(left) + hot + rng.choice(right)) for _ in range(250)]
    got = {}
    for r in repeats.remove_repeats(docs_of(rows)).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    assert {i: sorted(v) for i, v in got.items()} == brute_repeats(rows)


def test_repeats_text_and_empty(spark, docs_of):
    text = "Ein schöner Satz über Äpfel, lang genug für fünfzig Bytes und mehr. "
    got = {r.doc_id: r.kept_text for r in repeats.remove_repeats(docs_of([(1, "vor " + text), (2, "é" + text + "ü"), (3, None)]), with_text=True).collect()}
    assert got[1] == "vor " + text and got[3] == "" and text.strip() not in got[2] and got[2].startswith("é")
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_repeats_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)] for r in E.queries()["op3_remove_repeats"](spark, SF).collect()}
    assert got == brute_repeats([(r.doc_id, r.text) for r in docs])


def test_block_arrays_round_trip():
    a = arrays(x=np.arange(5), y=np.arange(5, dtype=np.uint16))
    got = unpacked(iter([a, a]))
    assert got["x"].tolist() == [*range(5)] * 2 and got["y"].dtype == np.uint16 and got["blob"].tolist() == [0] * 5 + [1] * 5


def test_decontaminate_cases(spark, docs_of, monkeypatch):
    item = "The quick brown fox jumps over the lazy dog while seven wizards box quietly near old barns today"
    long = " ".join(f"filler{i}" for i in range(5000))
    changed = item.replace("today", "tomorrow")
    rows = [(1, long + " " + item.upper().replace(" ", ", ") + " " + long), (2, long), (3, None), (4, ""), (5, changed), (6, item[:40]),
            (None, item), (7, item), (7, "nothing here at all to see"), (8, "four words only here")]
    items = spark.createDataFrame([(10, item), (11, item), (12, "four words only here"), (13, None), (None, "some other item text that is nowhere found")],
                                  "item_id long, text string")
    want = [(d, i) for d in (1, 5, 7, None) for i in (10, 11)]
    for limit in (500_000, 0):          # broadcast and shuffled
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
        got = decontaminate.contained_items(docs_of(rows), items)
        assert sorted(((r.doc_id, r.item_id) for r in got.collect()), key=str) == sorted(want, key=str)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert decontaminate.contained_items(none, items).collect() == []
    assert decontaminate.contained_items(docs_of(rows), none.withColumnRenamed("doc_id", "item_id")).collect() == []


def test_decontaminate_is_native(spark):
    plan = E.queries()["op2_decontaminate"](spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(6, 16))
    rows = []
    for i in range(160):
        v = base[i % 6] + rng.normal(scale=rng.choice([0.0, 0.1, 0.25, 0.4]), size=16)
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 2)))
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] * 16, 1), (203, [1.0] * 15 + [None], 1), (204, [float("inf")] * 16, 1),
             (205, rows[0][1], None), (206, [], 1), (207, rows[0][1][:8], 0), (None, rows[0][1], 0), (208, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")

    def ok(r):
        return r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])

    links = []
    for a, b in itertools.combinations(rows, 2):
        if ok(a) and ok(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
            x, y = np.array(a[1], float), np.array(b[1], float)
            if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                links.append((a[0], b[0]))
    order = lambda i: 10**9 if i is None else i
    root = brute_components([order(r[0]) for r in rows], [(order(a), order(b)) for a, b in links])
    got = {order(r.vec_id): r for r in embeddings.near_copies(df).collect()}
    assert len(got) == len(rows)
    for i, r in got.items():
        assert r.n_links == sum(i in (order(a), order(b)) for a, b in links)
        assert order(r.component_id) == root[i] and r.kept == (root[i] == i)


def test_embeddings_cells_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CELL", 16)
    monkeypatch.setattr(embeddings, "BLOCK", 8)
    test_embeddings_equal_brute_force(spark)
    assert embeddings.near_copies(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_count_threshold_is_calibrated():
    c = embeddings.least_count()
    rng = np.random.default_rng(0)
    hits = (np.abs(rng.normal(size=(200_000, embeddings.PROJECTIONS))) <= embeddings.HALF_WIDTH).sum(1)
    assert 15 < c < 30 and (hits < c).mean() < 1e-4


def test_minhash_many_null_ids(docs_of):
    rng = random.Random(8)
    base = [" ".join(rng.choices([f"w{i}" for i in range(400)], k=120)) for _ in range(12)]
    rows = [(None, varied(rng, b, c)) for b in base for c in (0, 0, 1, 2)] + [(1, base[0]), (1, base[1])]
    got = minhash.near_duplicates(docs_of(rows), 2).collect()
    assert sorted((str(r.component_id), r.kept) for r in got) == sorted([("1", False)] * 8 + [("1", True)] * 2 + [("None", True)] * 40)
    assert minhash.deduplicated(docs_of(rows)).count() == 12


def test_minhash_star_of_loose_members(docs_of):
    """Members that hardly resemble each other but a middle one, some of them linked by shared changes."""
    rng = random.Random(11)
    base = " ".join(rng.choices([f"w{i}" for i in range(500)], k=150))
    loose = [varied(rng, base, c) for c in (6, 8, 10, 12, 14, 16, 18, 20) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate([base, *loose, *[varied(rng, t, 3) for t in loose[20:]]])]
    sets = {i: shingles(t, 2) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = brute_components(sets, links)
    assert 1 < len(set(want.values())) < len(rows) - 1
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs_of(rows), 2).collect()} == want


@pytest.mark.parametrize("members", [1024, 8])
def test_minhash_group_of_loose_copies_in_tiles(docs_of, monkeypatch, members):
    """A group many of whose members aren't linked with its middle; small tiles cut it into many block pairs."""
    monkeypatch.setattr(minhash, "TILE_MEMBERS", members)
    rng = random.Random(12)
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(i, varied(rng, base, rng.choice((3, 9, 14, 18, 22)))) for i in range(160)]
    sets = {i: shingles(t, 2) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = brute_components(sets, links)
    assert 5 < len(set(want.values())) < 140
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs_of(rows), 2).collect()} == want


def test_tile_links_equal_pairs_and_grow_with_the_members():
    rng = np.random.default_rng(1)
    for trial in range(60):
        m = int(rng.integers(2, 30))
        only = [np.unique(rng.integers(0, 60, rng.integers(0, 40))).astype(np.uint64) for _ in range(m)]
        n, loose = rng.integers(40, 200, m), rng.random(m) < 0.5
        side = (rng.random(m) < 0.5).astype(int) if trial % 2 else np.zeros(m, int)
        pairs = []
        for i, j in itertools.combinations(range(m), 2):
            apart, both = len(np.setxor1d(only[i], only[j])), n[i] + n[j]
            if (not side.any() or side[i] != side[j]) and (loose[i] or loose[j]) and 100 * (both - apart) >= 80 * (both + apart):
                pairs.append((i, j))
        u, v = minhash.tile_links(n, loose, only, side)
        got = np.arange(m)
        got[u] = v
        assert dict(enumerate(got.tolist())) == brute_components(range(m), pairs) and len(u) < m
