"""BPE encoding and decoding by forced-boundary splitting.

Two neighbouring byte symbols that stand next to each other inside no token of
the vocabulary can never be merged over. Such pairs are certain cuts: a word is
split there, every fragment is merged on its own (many fragments at a time, as
rows of a numpy matrix) and the fragments' ids are concatenated. Normalization
and pre-splitting follow the tokenizer file (composed form, lower case, white
space dropped, letters / digits / rest apart, an end-of-word mark).

Defined results: null text counts as empty; an empty or white-space text has no
ids, and both digests are those of the empty string. Repeated rows each give a
row; further columns of the input are ignored. Very long words use a heap
instead of a matrix row. The word cache is bounded and only saves time.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import heapq
import itertools
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from prefspark.llm.tables import release

CACHE_WORDS = 120_000
MATRIX_WIDTH = 48
NO_RANK = np.int32(2**31 - 1)

#: Texts of these characters are in composed form, are lower-cased character by
#: character and split the same way by the plain pattern below.
_PLAIN = re.compile("[\x01-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]*\\Z")
_SEPARATORS = re.compile("[\x1c-\x1f]")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:_|[^\w\s])+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class ForcedBoundaryBpe:
    """Encoder and decoder of one tokenizer file with an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        # the library normalizes and splits only, so it gets no vocabulary: a worker keeps what is loaded
        self.lib = Tokenizer.from_str(json.dumps(spec | {"added_tokens": [], "post_processor": None, "model": model | {"vocab": {}, "merges": [], "unk_token": None}}))
        suffix, vocab = model["end_of_word_suffix"] or "", model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_cut = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.id_text, self.token_text = [f" {i}" for i in range(size)], [""] * size
        for t, i in (vocab | self.specials).items():
            self.token_text[i] = f" {t}"
        symbols = byte_symbols()
        # symbol ids: bytes inside a word, then bytes that end one; the vocabulary's ids are reused
        self.inner = np.array([vocab[s] for s in symbols], np.int32)
        self.last = np.array([vocab[s + suffix] for s in symbols], np.int32)
        self._pair_table([(vocab[a], vocab[b], vocab[a + b]) for a, b in
                          (m if isinstance(m, list) else m.split(" ") for m in model["merges"])])
        self.joined = self._inside_pairs(vocab, symbols, suffix)
        self.forget()

    def forget(self) -> None:
        """Empty the caches."""
        for name in ("rank_of", "token"):
            self.__dict__.pop(name, None)
        self.word_cache = TwoGenerations(self._encoded, CACHE_WORDS)
        self.chunk_cache = TwoGenerations(self._composed, CACHE_WORDS)

    @functools.cached_property
    def rank_of(self) -> dict[tuple[int, int], int]:
        """Pair of ids -> merge rank, made when a long fragment asks for it."""
        at = np.flatnonzero(self.keys >= 0)
        return {(k >> 20, k & 0xFFFFF): r for k, r in zip(self.keys[at].tolist(), self.ranks[at].tolist())}

    @functools.cached_property
    def token(self) -> dict[int, str]:
        return {i: t[1:] for i, t in enumerate(self.token_text) if t}

    def _inside_pairs(self, vocab, symbols, suffix) -> np.ndarray:
        """joined[x, y]: byte x is followed by byte y (y + 256 if it ends the word) in some token."""
        byte = {s: b for b, s in enumerate(symbols)}
        joined = np.zeros((256, 512), bool)
        for t in vocab:
            ends = t.endswith(suffix) and len(t) > len(suffix)
            body = [byte[c] for c in (t[: -len(suffix)] if ends else t)]
            for i, (x, y) in enumerate(zip(body, body[1:])):
                joined[x, y + 256 * (ends and i == len(body) - 2)] = True
        return joined

    def _pair_table(self, merges: list[tuple[int, int, int]]) -> None:
        """Open-addressing table: pair of ids -> merge rank; rank -> merged id."""
        self.bits = 19
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NO_RANK, np.int32)
        self.merged = np.array([m[2] for m in merges] + [0], np.int32)
        mask = (1 << self.bits) - 1
        for rank, (a, b, _) in enumerate(merges):
            key = a << 20 | b
            slot = int(self._slot(np.array([key], np.int64))[0])
            while self.keys[slot] not in (-1, key):
                slot = (slot + 1) & mask
            self.keys[slot], self.ranks[slot] = key, rank

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge rank of the pairs (a, b); NO_RANK where there is none or one is padding."""
        out = np.full(a.shape, NO_RANK, np.int32)
        rows = np.flatnonzero((a >= 0) & (b >= 0))
        key = a.ravel()[rows].astype(np.int64) << 20 | b.ravel()[rows].astype(np.int64)
        slot, flat, mask = self._slot(key), out.ravel(), (1 << self.bits) - 1
        while len(rows):
            got = self.keys[slot]
            hit = got == key
            flat[rows[hit]] = self.ranks[slot[hit]]
            go = ~hit & (got != -1)
            rows, key, slot = rows[go], key[go], (slot[go] + 1) & mask
        return out

    def _merge_rows(self, rows: np.ndarray) -> np.ndarray:
        """Apply the merges to each row of symbol ids (padding -1): lowest rank first, then leftmost."""
        n, width = rows.shape
        if n == 0 or width < 2:
            return rows
        out, at = np.full_like(rows, -1), np.arange(n)
        ranks = self._rank(rows[:, :-1], rows[:, 1:])
        cols = np.arange(width)
        while len(at):
            j = ranks.argmin(1)
            line = np.arange(len(at))
            best = ranks[line, j]
            done = best == NO_RANK
            if done.any():
                out[at[done]] = rows[done]
                go = ~done
                at, rows, ranks, j, best = at[go], rows[go], ranks[go], j[go], best[go]
                if not len(at):
                    break
                line = np.arange(len(at))
            rows[line, j] = self.merged[best]
            take = np.minimum(cols + (cols > j[:, None]), width - 1)
            rows = np.take_along_axis(rows, take, 1)
            rows[:, -1] = -1
            ranks = np.take_along_axis(ranks, np.minimum(take[:, :-1], width - 2), 1)
            ranks[:, -1] = NO_RANK
            right = np.where(j + 1 < width, rows[line, np.minimum(j + 1, width - 1)], -1)
            ranks[line[j < width - 1], j[j < width - 1]] = self._rank(rows[line, j], right)[j < width - 1]
            has = np.flatnonzero(j > 0)
            ranks[has, j[has] - 1] = self._rank(rows[has, j[has] - 1], rows[has, j[has]])
        return out

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same merges over one long fragment with a heap of candidate pairs."""
        n = len(ids)
        nxt, prv, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.rank_of.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            k = nxt[i]
            if not alive[i] or ids[i] != a or k < 0 or ids[k] != b:
                continue
            ids[i], alive[k], nxt[i] = int(self.merged[r]), False, nxt[k]
            if nxt[i] >= 0:
                prv[nxt[i]] = i
            for x, y in ((prv[i], i), (i, nxt[i])):
                if x >= 0 and y >= 0 and (q := self.rank_of.get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (q, x, ids[x], ids[y]))
        return [t for t, ok in zip(ids, alive) if ok]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each pre-split word: cut at forced boundaries, merge the fragments, concatenate."""
        special = {k: self.specials[w[1:]] for k, w in enumerate(words) if w[:1] == "\0" and w[1:] in self.specials}
        raw = [b"" if k in special else w.encode() for k, w in enumerate(words)]
        data = np.frombuffer(b"".join(raw), np.uint8).astype(np.int32)
        ends = np.cumsum([len(r) for r in raw])
        if not len(data):
            return [[special[k]] if k in special else [] for k in range(len(words))]
        is_last = np.zeros(len(data), bool)
        is_last[ends[ends > 0] - 1] = True
        symbols = np.where(is_last, self.last[data], self.inner[data]).astype(np.int32)
        cut = np.ones(len(data), bool)
        cut[1:] = is_last[:-1] | ~self.joined[data[:-1], data[1:] + 256 * is_last[1:]]
        start = np.flatnonzero(cut)
        length = np.diff(np.append(start, len(data)))
        out = np.full(len(data), -1, np.int32)      # a fragment's ids stand at its own start
        low = 1
        for width in (1, 4, 8, 16, MATRIX_WIDTH):
            of = np.flatnonzero((length >= low) & (length <= width))
            low = width + 1
            for some in np.array_split(of, max(1, len(of) // 20_000)):
                cols = np.arange(width)
                real = cols < length[some][:, None]
                idx = np.minimum(start[some][:, None] + cols, len(data) - 1)
                got = self._merge_rows(np.where(real, symbols[idx], -1).astype(np.int32))
                out[idx[real]] = got[real]
        for k in np.flatnonzero(length > MATRIX_WIDTH):
            got = self._merge_long(symbols[start[k]: start[k] + length[k]].tolist())
            out[start[k]: start[k] + len(got)] = got
        ids = out[out >= 0].tolist()
        count = np.concatenate(([0], np.cumsum(out >= 0)))[ends]
        return [[special[k]] if k in special else ids[a:b]
                for k, (a, b) in enumerate(zip([0, *count[:-1].tolist()], count.tolist()))]

    def _encoded(self, words: list[str]) -> list[tuple[str, str]]:
        """(ids, tokens) as text of distinct words, each with a leading blank."""
        return [("".join([self.id_text[i] for i in flat]), "".join([self.token_text[i] for i in flat]))
                for flat in self.encode_words(words)]

    def _composed(self, chunks: list[str]) -> list[tuple[str, str]]:
        """The same of white-space-free chunks, put together from their words."""
        split = [self.words(c) for c in chunks]
        known = self.word_cache.get(set().union(*split))
        out = []
        for words in split:
            if len(words) == 1:
                out.append(known[words[0]])
            else:
                both = [known[w] for w in words]
                out.append(("".join([b[0] for b in both]), "".join([b[1] for b in both])))
        return out

    def words(self, text: str) -> list[str]:
        """The tokenizer file's words of a text; special tokens stay whole, marked by a leading NUL."""
        if _PLAIN.match(text) and not (self.special_cut and self.special_cut.search(text)):
            return _PIECES.findall(text.lower())
        out = []
        for bit in self.special_cut.split(text) if self.special_cut else [text]:
            out += ["\0" + bit] if bit in self.specials else self._library_words(bit)
        return out

    def _library_words(self, text: str) -> list[str]:
        """Unusual characters: the tokenizer file's own normalizer and splitter, back to text."""
        back = {s: b for b, s in enumerate(byte_symbols())}
        pieces = self.lib.pre_tokenizer.pre_tokenize_str(self.lib.normalizer.normalize_str(text))
        return [bytes(back[ch] for ch in piece).decode() for piece, _ in pieces if piece]

    def digests(self, texts: Iterable[str]) -> Iterator[tuple[int, str, str]]:
        """(number of ids, ids joined by a blank, decoded text) of each text."""
        texts = iter(texts)
        while some := [_chunks(t) for t in itertools.islice(texts, 256)]:
            known = self.chunk_cache.get(set().union(*some))
            for chunks in some:
                both = [known[c] for c in chunks]
                ids = "".join([b[0] for b in both])
                yield ids.count(" "), ids[1:], "".join([b[1] for b in both])[1:]


class TwoGenerations:
    """A bounded cache: full, the young half becomes the old one; what is used again moves back."""

    def __init__(self, make, size: int):
        self.make, self.size, self.young, self.old = make, size, {}, {}

    def get(self, keys: set[str]) -> dict[str, tuple[str, str]]:
        """A mapping that holds all the keys."""
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}
        missing = keys - self.young.keys()
        new = []
        for k in missing:
            if (v := self.old.get(k)) is not None:
                self.young[k] = v
            else:
                new.append(k)
        self.young.update(zip(new, self.make(new)))
        return self.young


def _chunks(text: str) -> list[str]:
    """White-space-free chunks; white space is a boundary in every later step."""
    return [c for c in re.split("[\t-\r \x85\xa0]+", text) if c] if _SEPARATORS.search(text) else text.split()


def texts_of(col: pa.Array, rows: int = 256) -> Iterator[str | None]:
    """A column's texts, a few at a time."""
    for a in range(0, len(col), rows):
        yield from col.slice(a, rows).to_pylist()


_LOADED: dict[str, ForcedBoundaryBpe] = {}


def loaded(path: str) -> ForcedBoundaryBpe:
    """One encoder for each Python worker and file."""
    if path not in _LOADED:
        _LOADED[path] = ForcedBoundaryBpe(path)
    return _LOADED[path]


def bpe_roundtrip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                  keep_texts: bool = False) -> DataFrame:
    """Encode and decode every text: id, n_tokens, ids_sha256, decoded_sha256.

    ``keep_texts`` adds ``ids`` (decimal ids joined by a blank) and ``decoded``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            n, ids, dec = [], [], []
            hid, hdec = [], []
            for k, i, d in bpe.digests(t or "" for t in texts_of(batch.column(1))):
                n.append(k)
                hid.append(hashlib.sha256(i.encode()).hexdigest())
                hdec.append(hashlib.sha256(d.encode()).hexdigest())
                if keep_texts:
                    ids.append(i)
                    dec.append(d)
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(hid, pa.string()), pa.array(hdec, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_texts:
                cols, names = [*cols, pa.array(ids, pa.string()), pa.array(dec, pa.string())], [*names, "ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)
        bpe.forget()        # the worker lives on; its memory is for the next task's work
        gc.collect()
        release()

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(id_col, text_col).mapInArrow(run, schema + (", ids string, decoded string" if keep_texts else ""))
