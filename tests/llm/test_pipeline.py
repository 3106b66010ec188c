"""The pipeline's stages against brute force on whole small tables."""

import re

import corpus_pipeline as cp
import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def staged(spark, docs, tmp_path):
    out = [docs]
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, out[-1], SF).write.parquet(str(tmp_path / str(k)))
        out.append(spark.read.parquet(str(tmp_path / str(k))))
    return out


def terms5(text):
    w = [x for x in re.split(r"[\W_]+", text.lower()) if x]
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def brute_cut(texts):
    """Texts without the characters all of whose bytes lie in a 50-byte string of a smaller id."""
    seen, out = {}, {}
    for i in sorted(texts):
        b = texts[i].encode()
        for k in range(len(b) - 49):
            seen.setdefault(b[k:k + 50], i)
    for i, text in texts.items():
        b = text.encode()
        cut = bytearray(len(b))
        for k in range(len(b) - 49):
            if seen[b[k:k + 50]] < i:
                cut[k:k + 50] = b"\1" * 50
        at, kept = 0, []
        for c in text:
            n = len(c.encode())
            if not all(cut[at:at + n]):
                kept.append(c)
            at += n
        out[i] = "".join(kept)
    return out


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first, clean, single, cut, fair, coded = staged(spark, docs, tmp_path)
    for df in (clean, single, cut, fair):
        assert df.dtypes == first.dtypes
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    scores = {r.doc_id: r.predicted for r in E.queries()["op6_toxicity"](spark, SF).collect()}
    assert ids(clean) == {i for i, p in scores.items() if not p}
    from tests.llm.test_dedup import brute_components, shingles
    import itertools
    sets = {r.doc_id: shingles(r.text, 5) for r in clean.collect()}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert ids(single) == {i for i, r in brute_components(sets, links).items() if i == r}
    before = {r.doc_id: r.text for r in single.collect()}
    kept = brute_cut(before)
    assert {r.doc_id: r.text for r in cut.collect()} == kept and kept != before
    assert all(r.n_chars == len(r.text) for r in cut.collect() if r.text != before[r.doc_id])
    items = [terms5(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    fine = {i for i, t in kept.items() if not any(q and 100 * len(terms5(t) & q) >= 80 * len(q) for q in items)}
    assert ids(fair) == fine and {r.doc_id: r.text for r in fair.collect()} == {i: kept[i] for i in fine}
    assert ids(coded) == ids(fair) and coded.count() == fair.count()


def test_stages_with_odd_rows(spark, tmp_path):
    rows = [(1, None, "en", None, None, 1), (None, "a b c d e f", None, "s", 11, 2), (None, "a b c d e f", None, "s", 11, 3), (2, "", None, None, 0, 4),
            (3, "long words " * 3000, "en", "s", 1, 5), (3, "long words " * 3000, "en", "s", 1, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, block long")
    *_, fair, coded = staged(spark, docs, tmp_path)
    assert fair.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in coded.collect()))) == ["1", "2", "3", "None"]
    assert staged(spark, docs.limit(0), tmp_path / "none")[-1].count() == 0


def test_run(spark):
    got = cp.run(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() > 100
