"""Token-ID files with a minimal perfect hash index.

Documents are range-partitioned and sorted by key; every task encodes its texts
and writes shard files. A shard holds the raw ids of its documents one after the
other (little-endian, two bytes an id if the vocabulary allows it) and an index:
a minimal perfect hash (levels of bit arrays; a key rests on the first level
where no other key wants its bit, the bit's rank is its slot) with a stored
32-bit fingerprint, the start and the number of ids for each slot. The keys
themselves aren't stored. A lookup is a few bit probes, one fingerprint
comparison and one read at an offset.

Shards go to a folder that driver and executors share. Each task attempt writes
files of its own name and reports them in its rows, which are then written as a
table: files of failed attempts are never read.

Defined results: a null text has only the end id; a null key counts as the
smallest long and is returned as null; repeated keys are told apart by their
number of occurrence (in no particular order among themselves); an empty table
gives no rows and no files; other columns are ignored. Memory is bounded by a
shard's index, a run of texts and the remembered pieces.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from prefspark.llm.bpe import byte_symbols
from prefspark.llm.tables import materialize, partitions_for, row_runs, text_buffers
from prefspark.llm.words import Substrings
from prefspark.session import ensure_checkpoint_dir

MAGIC = 0x3158444E494B4F54
SHARD_BYTES = 32 << 20
REMEMBERED, RUN_BYTES = 1_500_000, 2 << 20
NULL_KEY = -(2**63)
GAMMA, LEVELS = 2.0, 64

# ---------------------------------------------------------------- hashing


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finalizer over unsigned keys."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(31)


def key_hashes(keys: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of (key, number of occurrence)."""
    k, n = keys.astype(np.int64).view(np.uint64), nth.astype(np.uint64)
    return mix(mix(k, 1) ^ n, 2), mix(mix(k, 3) ^ n, 4)


def level_bits(h1, h2, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(h1 + np.uint64(level) * (h2 | np.uint64(1)), 5) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash over n keys: ``sizes`` of the levels and their joined bits."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes.astype(np.int64), words
        self.base = np.concatenate(([0], np.cumsum(self.sizes)))
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words).astype(np.int64))))

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        sizes, bits, left = [], [], np.arange(len(h1))
        while len(left):
            if len(sizes) == LEVELS:
                raise ValueError("keys are not distinct")
            size = -(-int(len(left) * GAMMA + 1) // 64) * 64
            at = level_bits(h1[left], h2[left], len(sizes), size)
            wanted = np.bincount(at, minlength=size)
            sizes.append(size)
            bits.append(wanted == 1)
            left = left[wanted[at] > 1]
        flat = np.concatenate(bits) if bits else np.zeros(0, bool)
        return cls(np.array(sizes, np.int64), np.packbits(flat, bitorder="little").view(np.uint64))

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where no level has its bit (then the key isn't in the set)."""
        out, left = np.full(len(h1), -1, np.int64), np.arange(len(h1))
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = level_bits(h1[left], h2[left], level, size) + self.base[level]
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            low = word & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[hit]] = (self.before[at >> 6] + np.bitwise_count(low))[hit]
            left = left[~hit]
        return out


# ---------------------------------------------------------------- shard files


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder as Spark names it (file:/x, hdfs://..., /x)."""
    local = re.fullmatch(r"(?:file:)?/*(/.*)", uri)
    return (pafs.LocalFileSystem(), local[1]) if local else pafs.FileSystem.from_uri(uri)


class ShardWriter:
    """Writes ids document by document; the index follows when it is closed."""

    def __init__(self, fs: pafs.FileSystem, path: str, dtype: str):
        self.out, self.dtype = fs.open_output_stream(path), np.dtype(dtype)
        self.path, self.keys, self.nth, self.counts, self.bytes = path, [], [], [], 0

    def add(self, key: int, nth: int, ids: bytes) -> None:
        self.out.write(ids)
        self.keys.append(key)
        self.nth.append(nth)
        self.counts.append(len(ids) // self.dtype.itemsize)
        self.bytes += len(ids)

    def close(self) -> int:
        """Number of ids."""
        counts = np.array(self.counts, np.int64)
        h1, h2 = key_hashes(np.array(self.keys, np.int64), np.array(self.nth, np.int64))
        table = PerfectHash.build(h1, h2)
        slot = table.slots(h1, h2)
        prints, starts, sizes = np.zeros(len(slot), np.uint32), np.zeros(len(slot), np.uint64), np.zeros(len(slot), np.uint64)
        prints[slot] = (h2 >> np.uint64(32)).astype(np.uint32)
        starts[slot], sizes[slot] = np.cumsum(counts) - counts, counts
        pad = -self.bytes % 8
        self.out.write(b"\0" * pad)
        for part in (table.sizes.astype("<u8"), table.words.astype("<u8"), starts.astype("<u8"), sizes.astype("<u8"), prints.astype("<u4")):
            self.out.write(part.tobytes())
        footer = [MAGIC, self.dtype.itemsize, len(slot), int(counts.sum()), len(table.sizes), len(table.words), self.bytes + pad]
        self.out.write(np.array(footer, "<u8").tobytes())
        self.out.close()
        return int(counts.sum())


class ShardReader:
    """Keyed access to one shard file; only its index is held in memory."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.file = fs.open_input_file(path)
        end = self.file.size()
        footer = np.frombuffer(self.file.read_at(56, end - 56), "<u8")
        if int(footer[0]) != MAGIC:
            raise ValueError(f"{path} is not a shard")
        width, n, self.n_ids, levels, words, index = map(int, footer[1:])
        self.dtype = np.dtype(f"<u{width}")
        data, at = self.file.read_at(end - 56 - index, index), 0
        parts = []
        for count, kind in ((levels, "<u8"), (words, "<u8"), (n, "<u8"), (n, "<u8"), (n, "<u4")):
            parts.append(np.frombuffer(data, kind, count, at))
            at += count * np.dtype(kind).itemsize
        self.table, (self.starts, self.sizes, self.prints) = PerfectHash(*parts[:2]), parts[2:]

    def find(self, keys: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 for a key that is not in the shard (but for 2**-32 of strangers)."""
        h1, h2 = key_hashes(keys, nth)
        slot = self.table.slots(h1, h2)
        known = slot >= 0
        known[known] = self.prints[slot[known]] == (h2[known] >> np.uint64(32)).astype(np.uint32)
        return np.where(known, slot, -1)

    def ids(self, slot: int) -> np.ndarray:
        width = self.dtype.itemsize
        raw = self.file.read_at(int(self.sizes[slot]) * width, int(self.starts[slot]) * width)
        return np.frombuffer(raw, self.dtype)


# ---------------------------------------------------------------- encoding

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
BLANK, QUOTE = 0x20, 0x27
#: What follows a piece of other characters decides on its last white space.
ENDS, THEN_BLANK, THEN_LETTER = 0, 1, 2
SENTINEL = {ENDS: "", THEN_BLANK: " a", THEN_LETTER: "a"}


class PieceEncoder:
    """Ids of texts by the tokenizers library, each distinct piece encoded once while it is remembered.

    Letters with the blank before them are one piece of the byte-level splitter wherever they
    stand (but after an apostrophe, with which they may be a contraction). What stands between
    such pieces is encoded together with a stand-in for what follows. Texts with characters
    beyond Latin letters, or with special tokens, go through the library as they are."""

    def __init__(self, path: str):
        self.lib = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.lib.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.lib.get_vocab_size() <= 2**16 else "<u4")
        self.byte_text = dict(enumerate(byte_symbols()))
        self.forget()

    def forget(self) -> None:
        self.keys, self.start, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.store, self.used = np.zeros(1 << 20, self.dtype), 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, self.dtype)

    def _piece(self, piece: bytes, kind: int) -> list[int]:
        if kind < 0:
            return [t.id for t in self.lib.model.tokenize(piece.decode("latin-1").translate(self.byte_text))]
        ids = self.lib.encode(piece.decode() + SENTINEL[kind], add_special_tokens=False).ids
        return ids[:-1] if SENTINEL[kind] else ids

    def _learn(self, keys: np.ndarray, pieces: list[bytes], kinds: list[int]) -> None:
        """Add distinct pieces, given in the order of their keys."""
        got = [self._piece(p, k) for p, k in zip(pieces, kinds)]
        count = np.array([len(g) for g in got], np.int64)
        flat = np.fromiter((i for g in got for i in g), self.dtype, count.sum())
        while self.used + len(flat) > len(self.store):
            self.store = np.concatenate((self.store, np.zeros_like(self.store)))
        self.store[self.used: self.used + len(flat)] = flat
        start = self.used + np.cumsum(count) - count
        self.used += len(flat)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.start, self.count = (np.insert(x, at, y) for x, y in ((self.keys, keys), (self.start, start), (self.count, count)))

    def _unusual(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Rows that hold more than ASCII and Latin letters of two bytes, or a special token."""
        high = raw >= 0xC0
        odd = high & ((raw < 0xC3) | (raw > 0xC9))
        times = np.flatnonzero(raw[:-1] == 0xC3)
        odd[times] |= np.isin(raw[times + 1], (0x97, 0xB7))
        places = np.flatnonzero(odd).tolist()
        data = raw.tobytes()
        for s in self.special:
            at = data.find(s)
            while at >= 0:
                places.append(at)
                at = data.find(s, at + 1)
        out = np.zeros(len(offs) - 1, bool)
        out[np.searchsorted(offs, places, "right") - 1] = True
        return out

    def _plain(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows one after the other, and each row's first place in them."""
        n = len(raw)
        if not n:
            return np.zeros(0, self.dtype), np.zeros(len(offs), np.int64)
        letter = np.zeros(n + 1, bool)
        letter[:-1] = LETTER[raw]
        row_start = np.zeros(n + 1, bool)
        row_start[offs] = True
        begin = letter.copy()
        begin[1:] &= ~letter[:-1] | row_start[1:]
        begin = np.flatnonzero(begin)
        before = np.where(row_start[begin], 0, raw[begin - 1])
        begin = (begin - (before == BLANK))[before != QUOTE]
        after = ~letter
        after[1:] &= letter[:-1]
        after[0] = False
        cut = row_start
        cut[begin] = True
        is_word = np.zeros(n + 1, bool)
        is_word[begin] = True
        cut |= after
        cut[n] = False
        first = np.flatnonzero(cut)
        last = np.append(first[1:], n)
        word = is_word[first]
        kind = np.full(len(first), -1)
        other = np.flatnonzero(~word)
        following = np.minimum(last[other], n - 1)
        ends = np.zeros(n + 1, bool)
        ends[offs] = True
        # a contraction's letters end at a boundary whatever follows
        kind[other] = np.where(ends[last[other]] | letter[last[other] - 1], ENDS, np.where(raw[following] == BLANK, THEN_BLANK, THEN_LETTER))
        keys = Substrings(raw).hashes(first, last) + (kind + 1).astype(np.uint64)
        some, sample, which = np.unique(keys, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, some)
        known = np.zeros(len(some), bool)
        known[at < len(self.keys)] = self.keys[at[at < len(self.keys)]] == some[at < len(self.keys)]
        new = sample[~known]
        data = raw.tobytes()
        self._learn(some[~known], [data[a:b] for a, b in zip(first[new].tolist(), last[new].tolist())], kind[new].tolist())
        at = np.searchsorted(self.keys, some)[which]
        count = self.count[at]
        stop = np.cumsum(count)
        take = np.arange(stop[-1]) + np.repeat(self.start[at] - (stop - count), count)
        place = np.concatenate(([0], stop))
        return self.store[take], place[np.searchsorted(first, offs)]

    def encode(self, texts: pa.Array, end_id: int) -> Iterator[bytes]:
        """Ids of every text, ``end_id`` appended, as bytes."""
        end = np.array([end_id], self.dtype).tobytes()
        raw, offs = text_buffers(texts)
        for a, b in row_runs(offs, RUN_BYTES):
            if len(self.keys) > REMEMBERED:
                self.forget()
            own, part = offs[a: b + 1] - offs[a], raw[offs[a]: offs[b]]
            odd = self._unusual(part, own)
            size = np.where(odd, 0, np.diff(own))
            plain = part[np.repeat(~odd, np.diff(own))] if odd.any() else part
            ids, first = self._plain(plain, np.concatenate(([0], np.cumsum(size))))
            for i, whole in enumerate(odd.tolist()):
                yield (self.whole(part[own[i]: own[i + 1]].tobytes().decode()) if whole else ids[first[i]: first[i + 1]]).tobytes() + end


_LOADED: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder for each Python worker and file."""
    if path not in _LOADED:
        _LOADED[path] = PieceEncoder(path)
    return _LOADED[path]


# ---------------------------------------------------------------- Spark


def write_index(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, id_col: str = "doc_id",
                text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write shards in ascending key order; returns the written table (key, nth, part, seq, path, n_ids).

    A row for each document: its key, its shard; ``n_ids`` is the shard's, on the shard's last row only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        enc, seq, writer, last, nth = encoder(tokenizer), 0, None, None, 0
        keys, nths, seqs, paths, totals = [], [], [], [], []
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()

        def rows():
            n = len(keys)
            batch = pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(nths, pa.int64()), pa.array([part] * n, pa.int64()),
                 pa.array(seqs, pa.int64()), pa.array(paths, pa.string()), pa.array(totals, pa.int64())],
                ["key", "nth", "part", "seq", "path", "n_ids"])
            for x in (keys, nths, seqs, paths, totals):
                x.clear()
            return batch

        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1), end_id)):
                nth = nth + 1 if key == last else 0
                last = key
                if writer is None:
                    path = f"{base}/shard-{part:06d}-{seq:04d}-{uuid.uuid4().hex[:12]}.ids"
                    writer = ShardWriter(fs, path, enc.dtype)
                writer.add(key, nth, ids)
                keys.append(key), nths.append(nth), seqs.append(seq), paths.append(writer.path), totals.append(None)
                if writer.bytes >= shard_bytes:
                    totals[-1] = writer.close()
                    writer, seq = None, seq + 1
                    yield rows()
        if writer is not None:
            totals[-1] = writer.close()
        enc.forget()        # the worker lives on; its memory is for the next task's work
        if keys:
            yield rows()

    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_KEY)).alias("key")
    dealt = (docs.select(key, F.col(text_col).alias("text"))
             .repartitionByRange(partitions_for(docs), "key").sortWithinPartitions("key"))
    return materialize(dealt.mapInArrow(run, "key long, nth long, part long, seq long, path string, n_ids long"),
                       "token-index")


def read_index(index: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """Look every key up in its shard and digest its ids: id, start, n_tokens, ids_crc32."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        reader, opened = None, None
        for batch in batches:
            key, nth, path, base = (batch.column(i) for i in range(4))
            paths = path.to_pylist()
            key, nth, base = (c.to_numpy(zero_copy_only=False) for c in (key, nth, base))
            edges = [0, *[i for i in range(1, len(paths)) if paths[i] != paths[i - 1]], len(paths)]
            start, count, crc = (np.zeros(len(paths), np.int64) for _ in range(3))
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if paths[a] != opened:
                    reader, opened = ShardReader(fs, paths[a]), paths[a]
                for i, slot in enumerate(reader.find(key[a:b], nth[a:b]).tolist(), a):
                    if slot < 0:
                        raise KeyError(int(key[i]))
                    ids = reader.ids(slot)
                    start[i], count[i] = base[i] + int(reader.starts[slot]), len(ids)
                    crc[i] = zlib.crc32(ids.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (key, start, count, crc)],
                                             ["key", "start", "n_tokens", "ids_crc32"])

    # a row for each shard file, not for each document
    shards = index.where("n_ids is not null").select("part", "seq", "n_ids")
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = shards.select("part", "seq", before.alias("base"))
    keyed = (index.join(starts, ["part", "seq"]).select("key", "nth", "path", "base")
             .repartition(partitions_for(index), "path").sortWithinPartitions("path"))
    out = keyed.mapInArrow(run, "key long, start long, n_tokens long, ids_crc32 long")
    return out.select(F.expr(f"nullif(key, {NULL_KEY + 1} - 1)").alias(id_col), "start", "n_tokens", "ids_crc32")


def token_index(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id",
                text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Write the files, then read every document back by key."""
    folder = folder or f"{ensure_checkpoint_dir(docs.sparkSession).rstrip('/')}/token-index-{uuid.uuid4().hex[:12]}"
    return read_index(write_index(docs, tokenizer, folder, end_id, id_col, text_col), folder, id_col)
