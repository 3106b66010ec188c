"""Tokenizers, chat formatting, classifiers and LM scoring."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as E
from prefspark.llm import bpe, chat_format, language, maxent, token_index, toxicity

SF = "/root/testdata/sf0.001"
ODD = ["", "  ", "İstanbul ΣΑΣ ς Å ﬁ ½²", "a\x1cb c\x1d d", "x<|endoftext|>y <|startoftext|>", "it's they'LL é  z q 漢字 カ 한국어 🙂👩‍👩‍👧",
       "%" * 500 + " " + "ab" * 400, "́abc ẞ ß", "a_b 12 3.5 \x85k ﻿", "zq" * 60, "'s 's's don't", " a​b", "foo\n\n  bar  \n", "   a", "a \t b", "\0 a\0b"]


@pytest.fixture(scope="module")
def fuzz():
    rng = random.Random(4)
    parts = [" ", "  ", "a", "é", "'", "'s", "'ll", "the", "1", "23", ".", "\n", "\n\n", "\t", "×", "ß", "<|endoftext|>", " x", "|", "ſ", "\xa0", "\x1c", "日", "I", "́"]
    return ODD + ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(1500)]


def test_bpe_equals_library(spark, fuzz):
    path = P.path("word_bpe_49k.json")
    lib, own = Tokenizer.from_file(path), bpe.ForcedBoundaryBpe(path)
    for text, (n, ids, decoded) in zip(fuzz, own.digests(fuzz)):
        want = lib.encode(text, add_special_tokens=False).ids
        assert (n, ids, decoded) == (len(want), " ".join(map(str, want)), lib.decode(want, skip_special_tokens=False)), repr(text)


def test_bpe_cuts_hold_no_token():
    own = bpe.ForcedBoundaryBpe(P.path("word_bpe_49k.json"))
    assert 0 < (~own.joined).sum()
    for (a, b) in list(own.rank_of)[:2000]:
        t = own.token[a] + own.token[b]
        assert own.token[int(own.merged[own.rank_of[(a, b)]])] == t


def test_bpe_small_cache(fuzz, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 20)
    path = P.path("word_bpe_49k.json")
    assert list(bpe.ForcedBoundaryBpe(path).digests(fuzz)) == list(bpe.loaded(path).digests(fuzz))


def test_bpe_keeps_little_between_tasks():
    """What a worker holds of the tokenizer while other stages run: no second vocabulary, no pair table but the arrays."""
    own = bpe.ForcedBoundaryBpe(P.path("word_bpe_49k.json"))
    assert own.lib.get_vocab_size() == 0
    long = "".join(random.Random(1).choices("abcdefghij%", k=4000))
    assert next(own.digests([long]))[0] > 0 and own.rank_of and own.token
    own.forget()
    assert not {"rank_of", "token"} & vars(own).keys() and not own.word_cache.young and not own.chunk_cache.young


def test_bpe_rows(docs_of):
    got = {r.doc_id: r for r in bpe.bpe_roundtrip(docs_of([(1, None), (2, ""), (3, "a"), (None, "a")]), P.path("word_bpe_49k.json")).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert got[1][1:] == got[2][1:] == (0, nothing, nothing) and got[3][1:] == got[None][1:] and got[3].n_tokens == 1


def test_piece_encoder_equals_library(fuzz, monkeypatch):
    path = P.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    for remembered in (10**6, 5):
        monkeypatch.setattr(token_index, "REMEMBERED", remembered)
        own = token_index.PieceEncoder(path)
        for text, got in zip(fuzz, own.encode(pa.array(fuzz), 2)):
            assert np.frombuffer(got, own.dtype).tolist() == lib.encode(text, add_special_tokens=False).ids + [2], repr(text)


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(0).integers(-2**62, 2**62, 5000)
    h = token_index.key_hashes(keys, np.zeros(len(keys)))
    table = token_index.PerfectHash.build(*h)
    assert sorted(table.slots(*h)) == list(range(len(keys)))


def test_token_index_reads_back(spark, docs_of, tmp_path):
    rows = [(5, "five"), (3, None), (None, "nil"), (5, "five again"), (-9, ""), (70, "x " * 3000)]
    path = P.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    got = token_index.token_index(docs_of(rows), path, folder=str(tmp_path / "a"))
    ids = {i: sorted(zlib.crc32(np.array(lib.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for j, t in rows if j == i) for i, _ in rows}
    read = got.collect()
    assert {i: sorted(r.ids_crc32 for r in read if r.doc_id == i) for i in ids} == ids
    by_start = sorted(read, key=lambda r: r.start)
    assert [r.doc_id for r in by_start] == [None, -9, 3, 5, 5, 70]
    assert [r.start for r in by_start] == [0, *np.cumsum([r.n_tokens for r in by_start])[:-1].tolist()]
    index = token_index.write_index(docs_of(rows), path, str(tmp_path / "b"), shard_bytes=4)
    assert index.select("path").distinct().count() > 2
    assert sorted(map(str, token_index.read_index(index, str(tmp_path / "b")).collect())) == sorted(map(str, read))
    fs, _ = token_index.filesystem(str(tmp_path))
    reader = token_index.ShardReader(fs, index.where("key = 70").first().path)
    assert reader.find(np.array([71, 4, -1]), np.zeros(3, int)).tolist() == [-1] * 3
    assert token_index.token_index(spark.createDataFrame([], "doc_id long, text string"), path, folder=str(tmp_path / "c")).collect() == []


def test_token_index_query(spark):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    lib, want, start = Tokenizer.from_file(P.path("byte_bpe_50k.json")), {}, 0
    for r in docs:
        ids = np.array(lib.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
        want[r.doc_id] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r.doc_id: tuple(r[1:]) for r in E.queries()["op10_token_index"](spark, SF).collect()} == want


def test_chat_round_trip(spark):
    texts = ["", None, "</turn>", "### user: x", "&lt;&amp;&num;&colon;", "<and>", "a\nb", "é日🙂", "&", "#", "<", ":", "&&lt;"]
    rng = random.Random(1)
    turns = [(c, rng.choice([None, *range(5)]), rng.choice(["user", "assistant", "system", "odd: <role>#&", None, ""]), rng.choice(texts))
             for c in [*range(30), None] for _ in range(rng.randrange(1, 9))]
    turns += turns[:5]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    chats = chat_format.format_chats(df)
    got = {r.conv_id: r for r in chat_format.chat_digests(chats).collect()}
    full = {r.conv_id: r for r in chats.collect()}
    for c in {t[0] for t in turns}:
        own = sorted(((t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in turns if t[0] == c))
        loss = "".join(t[3] for t in own if t[2] == "assistant")
        r = got[c]
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in own).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == len(full[c].formatted) == sum(x.chars for x in full[c].loss_mask)
        merged = 1 + sum(a[2] != b[2] for a, b in zip(own, own[1:]))
        assert full[c].formatted.count("</turn>") == full[c].formatted.count("### ") == merged
    assert chat_format.chat_digests(chat_format.format_chats(df.limit(0))).collect() == []


def labelled(rng, n):
    plain, bad, group = [f"w{i}" for i in range(200)], ["zork", "blib"], ["them", "those"]
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(plain, k=rng.randrange(5, 60))
        kind = rng.randrange(4)
        if kind in (1, 3):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        if kind in (2, 3):
            words.insert(rng.randrange(len(words)), rng.choice(group))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(kind == 3)))       # only both together are toxic
    return rows, labels


def test_toxicity_learns_pairs(spark, docs_of):
    rows, labels = labelled(random.Random(2), 1500)
    extra = [(9000, None), (9001, ""), (None, "zork them"), (9002, "w1 " * 50_000)]
    df = docs_of(rows + extra)
    lab = spark.createDataFrame([*labels, (0, 1, None), (None, 1, 1), (77777, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(df, lab).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = {i: y for i, _, y in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 200 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.93
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert toxicity.toxicity(df, lab.limit(0)).agg({"score": "max"}).first()[0] < 1e-6
    assert toxicity.toxicity(df.limit(0), lab).collect() == []


def test_toxicity_learns_pairs_of_neutral_terms():
    rng, plain, p = random.Random(3), [f"w{i}" for i in range(200)], 0.3
    texts, kinds = [], []
    for _ in range(3000):
        insult, group = rng.random() < p, rng.random() < p
        other = not insult and not group and rng.random() < p / (1 - p)
        words = rng.choices(plain, k=rng.randrange(5, 60)) + ["zork"] * insult + ["them"] * group + ["vile"] * other
        rng.shuffle(words)
        texts.append(" ".join(words))
        kinds.append((insult and group, int(insult and group or other)))
    terms = [t[x:y] for t, f in toxicity.batch_terms(pa.array(texts)) for x, y in zip(f, f[1:])]
    samples = [(t, y) for t, (_, y) in zip(terms, kinds)]
    fm = toxicity.fit(samples[:2000])
    scores = [fm.score(t, np.array([0, len(t)]))[0] for t in terms]
    # either term alone is toxic as often as any text
    rate = sum(y for _, y in kinds[:2000]) / 2000
    for word in ("zork", "them"):
        own = [y for t, (_, y) in zip(texts[:2000], kinds) if word in t.split()]
        assert abs(sum(own) / len(own) - rate) < 3 * math.sqrt(rate * (1 - rate) / len(own))
    held = list(zip(scores, kinds))[2000:]
    pairs = [s for s, (both, _) in held if both]
    assert len(pairs) > 50 and sum(s >= 0.5 for s in pairs) / len(pairs) > 0.9
    assert sum((s >= 0.5) == y for s, (_, y) in held) / len(held) > 0.95


def test_language_gradient():
    net = language.ByteNetwork(["a", "b"])
    net.p = {k: w.astype(np.float64) for k, w in net.p.items()}
    data = np.random.default_rng(0).integers(97, 110, (9, 5)).astype(np.uint8)
    length, label = np.array([9, 3, 5, 9, 1]), np.array([0, 1, 1, 0, 1])

    def loss():
        y = net.log_probs(data)[:, label, np.arange(5)]
        return -(y * (np.arange(9)[:, None] < length)).sum() / length.sum()

    g = net.gradient(data, length, label)
    for k, w in net.p.items():
        i = np.unravel_index(np.abs(g[k]).argmax(), w.shape)
        kept, w[i] = w[i], w[i] + 1e-2
        up = loss()
        w[i] = kept - 1e-2
        down, w[i] = loss(), kept
        assert abs((up - down) / 2e-2 - g[k][i]) < 1e-4


def test_language_cases(spark, docs_of):
    rng = random.Random(6)
    words = {"aa": ["kali", "mora", "tipu"], "bb": ["schwert", "zwölf", "grün"], "cc": ["être", "où", "ça"]}
    rows = [(i, " ".join(rng.choices(words[x], k=rng.randrange(1, 40))), x) for i in range(600) for x in [rng.choice([*words])]]
    odd = [(9000, None, "aa"), (9001, "", "bb"), (9002, "123 !?", "cc"), (9003, "mora tipu", None), (None, "grün zwölf", "aa"), (9004, "kali " * 40_000, "aa")]
    got = {r.doc_id: r for r in language.languages(docs_of(rows + odd)).collect()}
    held = [(got[i].lang_pred, x) for i, _, x in rows if got[i].held_out]
    assert len(held) > 80 and sum(a == b for a, b in held) / len(held) > 0.95
    assert [(got[i].lang_pred, got[i].score) for i in (9000, 9001, 9002)] == [("und", 0.0)] * 3
    assert (got[9003].lang_pred, got[None].lang_pred, got[9004].lang_pred) == ("aa", "bb", "aa")
    assert got[9004].n_positions == 200_000 and all(0 <= r.score <= 1 for r in got.values())
    unknown = docs_of([(1, "x y", None)])
    assert [r.lang_pred for r in language.languages(unknown).collect()] == ["und"]
    assert language.languages(unknown.limit(0)).collect() == []


def test_language_learns_from_the_whole_text(docs_of):
    rng, rows = random.Random(8), []
    words = {"aa": ["kali", "mora", "tipu"], "bb": ["schwert", "zwolf", "grun"]}
    for i in range(400):
        x, same = rng.choice([*words]), "1234 5678 " * 12
        part = lambda: " ".join(rng.choices(words[x], k=150))[:600]
        rows.append((i, same + part() + same + part() + same, x))       # start, middle and end are the same in both
    got = {r.doc_id: r for r in language.languages(docs_of(rows)).collect()}
    held = [(got[i].lang_pred, x) for i, _, x in rows if got[i].held_out]
    assert len(held) > 50 and sum(a == b for a, b in held) / len(held) > 0.95


def test_lm_base_and_gain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    lower = {c: c + 32 for c in range(65, 91)}
    tokens = {r.doc_id: re.findall("[^\x20\x09-\x0d]+", (r.text or "").translate(lower)) + [None] for r in docs}
    count = collections.Counter(t for i, own in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for t in own)
    n, v = sum(count.values()), len(count)
    got = {r.doc_id: r for r in E.queries()["op4_lm_scores"](spark, SF).collect()}
    assert got.keys() == tokens.keys()
    for i, own in tokens.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(t in count for t in own), n)
        assert math.isclose(r.base_score, sum(math.log10((count[t] + 1) / (n + v + 1)) for t in own), rel_tol=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_model_is_a_distribution():
    model = maxent.Model(np.arange(maxent.CLASSES * maxent.SLOTS))
    rng = np.random.default_rng(1)
    tokens = rng.integers(0, 2**64, 300, np.uint64)
    model.add_gradient(tokens, np.array([0, 100, 300]), g := model.empty_gradient())
    model.update(g)
    assert g["class_n"].sum() == 5 * 300
    context = maxent.features(tokens, np.array([0, 100, 300]))[:, 5:6]
    total = 0.0
    for cls in range(maxent.CLASSES):
        c, s = model.rows(context, np.array([cls]))
        total += (np.exp(model.log_probs(c, model.by_class)[0, cls]) * np.exp(model.log_probs(s, model.by_slot))).sum()
    assert abs(total - 1) < 1e-4


def test_lm_context_gain_holds_as_the_corpus_grows(docs_of):
    gains = []
    for n in (200, 800):
        rng, words, rows = random.Random(n), 5 * n, []
        after = rng.sample(range(words), words)
        for i in range(n):
            w, own = rng.randrange(words), []
            for _ in range(100):
                own.append(f"w{w}")
                w = after[w] if rng.random() < 0.9 else rng.randrange(words)
            rows.append((i, " ".join(own)))
        held = [r for r in maxent.lm_scores(docs_of(rows)).collect() if r.held_out]
        gains.append(sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held))
    assert gains[1] > gains[0] > 1.6, gains


def test_lm_cases(spark, docs_of):
    got = {r.doc_id: r for r in maxent.lm_scores(docs_of([(1, None), (2, ""), (None, "a b"), (3, "a  B\ta"), (4, "z " * 20_000)])).collect()}
    assert got[1][2:] == got[2][2:] and got[1].n_tokens == 1 and got[None].held_out and got[4].n_tokens == 20_001
    assert maxent.lm_scores(spark.createDataFrame([], "doc_id long, text string")).collect() == []
