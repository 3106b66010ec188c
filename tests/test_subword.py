"""B8 and U3 with subword tokenizers: equal to the library and to the literal loop."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from prefspark.operators import subword as sw
from prefspark.operators import text as tx

SF = "/root/testdata/sf0.001"
FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


def literal(text, limit, count):
    while count(text) > limit and text:
        text = "\n".join(text.split("\n")[:-1])
    return text


def samples(rng, n):
    words = ["don't", "it's", "straße", "naïve", "日本語", "<|endoftext|>", "a", "I'll", "x" * 40, "\t", " ", "  ", "é", "1234", "!!!", "\r"]
    return ["\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(8))) + rng.choice(["", "", " ", "   "]) for _ in range(rng.randrange(1, 14)))
            for _ in range(n)] + ["", "\n", "\n\n\n", " \n \n ", "a\n", "\nabc def"]


@pytest.mark.parametrize("file", FILES)
def test_truncation_equals_the_literal_loop(spark, file):
    model = Tokenizer.from_file(public_tokenizers.path(file))
    model.no_truncation()
    texts = samples(random.Random(file), 300)
    count = lambda t: len(model.encode(t, add_special_tokens=False))
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "id long, t string").repartition(3)
    for limit in (0, 3, 17):
        got = {r.id: r.t for r in sw.truncate_lines_library(df, "t", limit, public_tokenizers.path(file), "|").collect()}
        assert got == {i: literal(t, limit, count) + "|" for i, t in enumerate(texts)} | {len(texts): None}


def test_least_is_a_lower_bound():
    for file in FILES:
        tok = sw.LibraryTokenizer(public_tokenizers.path(file))
        for text in samples(random.Random(1), 200):
            ends = list(range(len(text) + 1))
            assert (np.array(tok.counts([text[:e] for e in ends])) >= tok.least(text, ends)).all()


class Odd:
    """A count that isn't monotonic and has no bound; remembers what it was asked."""

    def __init__(self):
        self.asked = 0

    def counts(self, texts):
        self.asked += len(texts)
        return [zlib.crc32(t.encode()) % 50 for t in texts]

    def least(self, text, ends):
        return [0] * len(ends)


def test_counts_that_are_not_monotonic():
    odd = Odd()
    texts = samples(random.Random(2), 400)
    assert sw.longest_fitting(texts, 7, odd) == [literal(t, 7, lambda x: zlib.crc32(x.encode()) % 50) for t in texts]


def test_few_prefixes_are_tokenized():
    tok = sw.LibraryTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    asked = []
    counts = tok.counts
    tok.counts = lambda texts: asked.extend(texts) or counts(texts)
    text = "\n".join(f"line number {k} of a long text" for k in range(2000))
    got = sw.longest_fitting([text], 100, tok)[0]
    assert got == literal(text[:2000], 100, lambda t: counts([t])[0]) and len(asked) <= 4


@pytest.mark.parametrize("file", FILES)
def test_ids_equal_the_library(spark, file):
    model = Tokenizer.from_file(public_tokenizers.path(file))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    df = docs.union(spark.createDataFrame([(-1, None), (-2, "")], docs.schema)).withColumn("ids", sw.library_ids("text", public_tokenizers.path(file)))
    rows = df.collect()
    assert len(rows) > 100
    for r in rows:
        assert r.ids == model.encode(r.text or "", add_special_tokens=False).ids


def test_library_counter_in_the_length_filter(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    df = spark.createDataFrame([("a b c",), ("a b c d e",), (None,)], "prompt string")
    keep, stats = tx.filter_prompt_length(df, 4, counter=sw.library_counter(path))
    assert sorted(str(r.prompt) for r in keep.collect()) == ["None", "a b c"] and stats.first().n_removed == 1


class Watched:
    """A model that remembers how many characters went through it."""

    def __init__(self, model):
        self.model, self.seen = model, 0
        self.pre_tokenizer = model.pre_tokenizer

    def encode(self, text, **kw):
        self.seen += len(text)
        return self.model.encode(text, **kw)

    def encode_batch(self, texts, **kw):
        self.seen += sum(map(len, texts))
        return self.model.encode_batch(texts, **kw)


def test_a_long_text_is_encoded_whole_only_once():
    tok = sw.LibraryTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    text = "\n".join(f"line number {k} of a long text" for k in range(200))
    want = literal(text, 100, lambda t: tok.counts([t])[0])
    tok.model = Watched(tok.model)
    assert sw.longest_fitting([text], 100, tok) == [want]
    assert tok.model.seen < len(text) + 2 * len(want) + 200


def test_ids_of_two_tokenizers_share_a_worker(spark):
    df = spark.createDataFrame([("a b",), (None,)], "text string")
    both = df.select(*[sw.library_ids("text", public_tokenizers.path(f)).alias(f[:4]) for f in FILES])
    assert both._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_text_runs_are_bounded():
    import pyarrow as pa
    texts = ["", None, "abc", "é" * 30, "de", "f" * 9, None, "g"]
    got = list(sw.text_runs(pa.array(["skipped", *texts]).slice(1), 10))
    assert [t for r in got for t in r] == [t or "" for t in texts]
    assert all(len(r) == 1 or sum(len(t.encode()) for t in r) <= 10 for r in got) and list(sw.text_runs(pa.array([], pa.string()))) == []
