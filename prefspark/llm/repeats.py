"""Exact removal of repeated byte strings by prefix-free parsing.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts in a
document with a smaller id. Texts are parsed into phrases at rolling-hash
triggers: of the 7-byte strings in a window of ``LENGTH`` bytes the one with the
least hash names the window's trigger, a string of ``TRIGGER`` bytes inside the
window. A run of window starts with the same trigger is a phrase; with the
``LENGTH - 1`` bytes that follow, consecutive phrases overlap such that every
window lies in exactly one phrase, and equal windows have equal triggers at equal
places. Phrases therefore decide everything:

1. Dictionary. Each block of documents reports its distinct phrases (trigger,
   content hash, smallest id). The dictionary is sorted by trigger, content and
   id: a phrase that a smaller id has too is removed as a whole, with all its
   windows. Highly repetitive text ends here, a phrase for about 15 bytes.
2. Suffix arrays. A trigger with different contents has matches that begin or end
   inside a phrase. Such phrases go, as bytes, in two parts to the dictionary's
   buckets: the windows that reach ``SIDE`` bytes or more to the trigger's left, and
   the others, which reach as far to its right. All windows of a part hold the same
   ``ANCHOR`` bytes, which name its bucket, so a hot trigger's contexts lie apart.
   In a bucket the suffixes of the parts are sorted by prefix doubling; neighbours
   in that order with ``LENGTH`` bytes in common are one string, removed but at its
   smallest id.
3. Parse. Every block is parsed again, the answers for its phrases and their
   windows are laid over the text in corpus order, and overlapping strings merge
   into spans. No window leaves its phrase, so the order of whole parses (their
   own suffix array) decides nothing and isn't built.

Hot text costs an entry for each block, not for each document. Answers return by
block; no text is collected anywhere, and nothing is dropped or capped.

Defined results: null text is empty; texts shorter than ``LENGTH`` bytes lose
nothing; repeats inside one document and between rows of equal id don't count;
a null id counts as the smallest; an empty table gives no rows; other columns
are ignored. Windows are compared by their bytes, phrases by 64 bits within a block
and by 96 between blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from prefspark.llm import blocks as bl
from prefspark.llm.tables import materialize, partitions_for
from prefspark.llm.words import Substrings

LENGTH = 50
GRAM, STEP = 7, 22                    # LENGTH - GRAM + 1 = 2 * STEP grams in a window
TRIGGER = LENGTH - STEP + 1
SIDE, ANCHOR = 11, 40                 # a window reaches SIDE bytes to one side of its trigger; ANCHOR = TRIGGER + SIDE
WIDTH = 64                            # bytes a part takes: LENGTH + SIDE - 1, padded
SLICE = 1 << 14                       # parts that are sorted at a time; a part's anchor isn't divided
BUCKET_BLOCKS = 64                    # blocks of text for each bucket, at least
SEGMENT = 1 << 17
NULL_ID = -(2**63)


def _triggers(data: np.ndarray) -> np.ndarray:
    """Trigger position of each window start of at most 2**23 bytes."""
    n = len(data) - LENGTH + 1
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    grams = np.ndarray((len(data) - GRAM + 1,), "<u8", padded, strides=(1,)) & np.uint64(2**56 - 1)
    grams *= np.uint64(0x9E3779B97F4A7C15)
    grams ^= grams >> np.uint64(31)
    grams *= np.uint64(0xD6E8FEB86659FD93)
    low = (grams & ~np.uint64(2**24 - 1)) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while 2 * width <= 2 * STEP:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = 2 * STEP - width
    if rest:
        low = np.minimum(low[:-rest], low[rest:])
    start = np.arange(n)
    at = (low[:n] & np.uint64(2**24 - 1)).astype(np.int64)
    return start + (at - start) % STEP


class Parse:
    """The phrases of a block: window starts first..last, trigger place, row; hashes of both."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray):
        self.raw, self.offs = raw, offs
        first, last, trigger = [], [], []
        for a in range(0, max(0, len(raw) - LENGTH + 1), SEGMENT):
            part = raw[a: a + SEGMENT + LENGTH - 1]
            t = _triggers(part)
            n = len(t)
            whole = np.ones(n + 1, bool)        # the window ends in the row it starts in
            whole[n] = False
            for cut in offs[np.searchsorted(offs, a + 1): np.searchsorted(offs, a + n + LENGTH - 1)] - a:
                whole[max(0, cut - LENGTH + 1): min(n, cut)] = False
            change = np.ones(n + 1, bool)
            change[1:n] = t[1:] != t[:-1]
            begin = whole[:n].copy()
            begin[1:] &= change[1:n] | ~whole[: n - 1]
            end = whole[:n] & (change[1:] | ~whole[1:])
            first.append(np.flatnonzero(begin) + a)
            last.append(np.flatnonzero(end) + a)
            trigger.append(t[np.flatnonzero(begin)] + a)
        none = [np.zeros(0, np.int64)]
        self.first, self.last, self.trigger = (np.concatenate(x or none) for x in (first, last, trigger))
        self.row = np.searchsorted(offs, self.first, "right") - 1
        self.strings = Substrings(raw)
        self.content = self.strings.hashes(self.first, self.last + LENGTH)
        self.anchor = self.strings.hashes(self.trigger, self.trigger + TRIGGER)

    def parts(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Name (twice the phrase, and one for the right), first and last window and anchor of the phrases' parts."""
        first, last, trigger = self.first[phrases], self.last[phrases], self.trigger[phrases]
        name = np.concatenate((2 * phrases, 2 * phrases + 1))
        begin = np.concatenate((first, np.maximum(first, trigger - SIDE + 1)))
        end = np.concatenate((np.minimum(last, trigger - SIDE), last))
        anchor = np.concatenate((trigger - SIDE, trigger))
        real = begin <= end
        return name[real], begin[real], end[real], anchor[real]

    def bytes_of(self, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Strings of at most ``WIDTH`` bytes as rows, filled up with zeros."""
        padded = np.concatenate((self.raw, np.zeros(WIDTH, np.uint8)))
        rows = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[begin]
        rows[np.arange(WIDTH) >= size[:, None]] = 0
        return rows


def ranked(values: np.ndarray) -> np.ndarray:
    """The rank of each value among the distinct ones."""
    flat = values.ravel()
    order = np.argsort(flat)
    new = np.diff(flat[order], prepend=flat[order][:1]) != 0
    rank = np.empty(len(flat), np.uint64)
    rank[order] = np.cumsum(new).astype(np.uint64)
    return rank.reshape(values.shape)


def suffix_ranks(rows: np.ndarray) -> np.ndarray:
    """For each row of bytes the rank, in byte order, of the ``LENGTH`` bytes at its first ``SIDE`` places
    among all suffixes of the rows: prefix doubling over 8, 16, 32 and ``LENGTH`` bytes."""
    n, span, width = len(rows), SIDE + LENGTH - 1, 8
    rank = np.ndarray((n, span - width + 1), ">u8", np.ascontiguousarray(rows), strides=(rows.shape[1], 1)).astype(np.uint64)
    while width < LENGTH:
        rank = ranked(rank)
        step = min(width, LENGTH - width)
        rank = rank[:, : rank.shape[1] - step] << np.uint64(32) | rank[:, step:]
        width += step
    return ranked(rank)


def parsed(table: pa.Table) -> tuple[np.ndarray, Parse]:
    """Ids of the rows and the parse of a block."""
    from prefspark.llm.tables import text_buffers
    return table.column(0).to_numpy(), Parse(*text_buffers(table.column(1)))


def least_per(keys: np.ndarray | tuple[np.ndarray, ...], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each distinct key: the entry with the smallest id; and for each entry its key's number and smallest id.

    Several arrays are one key together."""
    keys = keys if isinstance(keys, tuple) else (keys,)
    order = np.lexsort((ids, *keys))
    new = np.zeros(len(ids), bool)
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    new[:1] = True
    number = np.empty(len(ids), np.int64)
    number[order] = np.cumsum(new) - 1
    head = order[new]
    return head, number, ids[head][number] if len(ids) else ids


def elsewhere(e: dict[str, np.ndarray]) -> np.ndarray:
    """For each part the windows that a part with a smaller id holds too, as bits.

    Only parts with equal anchors can share a window, and they are sorted together."""
    bits = np.zeros(len(e["id"]), np.uint16)
    _, number, least = least_per(e["key"], e["id"])
    several = np.bincount(number, e["id"] > least, int(number.max(initial=0)) + 1) > 0
    at = np.flatnonzero(several[number])
    at = at[np.argsort(number[at], kind="stable")]
    bound = np.flatnonzero(np.diff(number[at], append=-1)) + 1           # the ends of the anchors
    a = 0
    while a < len(at):
        b = int(bound[max(np.searchsorted(bound, a + SLICE, "right") - 1, np.searchsorted(bound, a, "right"))])
        own = at[a:b]
        rank = suffix_ranks(e["string"][own])
        i, j = np.nonzero(np.arange(SIDE) < e["windows"][own][:, None])
        ids = e["id"][own][i]
        _, _, smallest = least_per(rank[i, j], ids)
        i, j = i[ids > smallest], j[ids > smallest]
        bits[own] = np.bincount(i, 1 << j, len(own)).astype(np.uint16)
        a = b
    return bits


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (),
                   with_text: bool = False) -> DataFrame:
    """A row for each row of docs: id (or the columns ``keep``), n_bytes, n_removed, n_spans, kept_sha256;
    ``with_text`` adds kept_text, without the characters that lie in a span as a whole."""
    order = F.coalesce(F.col(id_col).cast("long"), F.expr(f"{NULL_ID + 1} - 1")).alias("__order")
    keep = keep or (id_col,)
    packed = bl.text_blocks(docs.select(order, *[F.col(c).alias(f"__{c}") for c in keep], F.col(text_col).alias("__text")),
                            "__order", *[f"__{c}" for c in keep], "__text")
    buckets = max(partitions_for(docs), packed.count() // BUCKET_BLOCKS)
    narrow = lambda table: table.select(["__order", "__text"])

    def report_phrases(block: int, table: pa.Table, _) -> Iterator[pa.RecordBatch]:
        ids, p = parsed(narrow(table))
        head, _, _ = least_per(p.content, ids[p.row])
        head = np.sort(head)
        anchor, content = p.anchor[head], p.content[head]
        yield from bl.by_bucket(block, ((anchor >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32),
                                anchor=anchor.astype(np.uint32), content=content, id=ids[p.row[head]], phrase=head.astype(np.uint32))

    def sort_dictionary(e: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, dict[str, np.ndarray]]]:
        anchor = e["anchor"]
        head, number, least = least_per((e["content"], anchor), e["id"])
        removed = e["id"] > least
        # triggers with several contents, of several ids: the holders of each content with its smallest id
        # show theirs (rows of equal id can lie in several blocks)
        _, trigger, least_of_trigger = least_per(anchor[head], e["id"][head])
        contents = np.bincount(trigger, minlength=1)
        several = np.bincount(trigger, e["id"][head] > least_of_trigger, len(contents)) > 0
        shown = ((contents > 1) & several)[trigger][number] & (e["id"] == least)
        either = removed | shown
        yield either, {"phrase": e["phrase"], "whole": removed.astype(np.uint8)}

    def answers(blobs: list[bytes], name: str) -> dict[str, np.ndarray] | None:
        own = [t for t in map(bl.unpack, blobs) if name in t.column_names]
        if not own:
            return None
        table = pa.concat_tables(own).combine_chunks()
        return {n: table.column(n).to_numpy() for n in table.column_names}

    def settled(ids: np.ndarray, p: Parse, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases removed as a whole, each phrase's content number, and one phrase for each shown content."""
        got = answers(blobs, "phrase")
        id_of = ids[p.row]
        head, number, least = least_per(p.content, id_of)
        whole, show = np.zeros(len(head), bool), np.zeros(len(head), bool)
        if got:
            whole[number[got["phrase"][got["whole"] == 1]]] = True
            show[number[got["phrase"][got["whole"] == 0]]] = True
        return whole[number] | (id_of > least), number, np.sort(head[show])

    def report_parts(block: int, table: pa.Table, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        ids, p = parsed(narrow(table))
        _, _, shown = settled(ids, p, blobs)
        name, begin, end, anchor = p.parts(shown)
        key = p.strings.hashes(anchor, anchor + ANCHOR)
        yield from bl.by_bucket(block, ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32),
                                key=key.astype(np.uint32), id=ids[p.row[name // 2]], part=name.astype(np.uint32),
                                windows=(end - begin + 1).astype(np.uint8), string=p.bytes_of(begin, end - begin + LENGTH))

    def sort_suffixes(e: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, dict[str, np.ndarray]]]:
        bits = elsewhere(e)
        yield bits > 0, {"part": e["part"], "bits": bits}

    def lay_over(block: int, table: pa.Table, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        ids, p = parsed(narrow(table))
        removed, number, _ = settled(ids, p, blobs)
        single = [np.zeros(0, np.int64)]
        if got := answers(blobs, "part"):
            for side, begin in enumerate((p.first, np.maximum(p.first, p.trigger - SIDE + 1))):
                bits, own = np.zeros(number.max(initial=-1) + 1, np.uint16), got["part"] % 2 == side
                bits[number[got["part"][own] // 2]] = got["bits"][own]
                at = np.flatnonzero((bits[number] > 0) & ~removed)
                i, j = np.nonzero(bits[number[at]][:, None] >> np.arange(SIDE, dtype=np.uint16) & 1)
                single.append(begin[at][i] + j)
        single = np.concatenate(single)
        size = len(p.raw) + 1
        edge = np.bincount(np.concatenate((p.first[removed], single)), minlength=size)
        edge -= np.bincount(np.concatenate((p.last[removed], single)) + LENGTH, minlength=size)
        gone = np.cumsum(edge[:-1]) > 0
        n = table.num_rows
        n_removed, n_spans, digest, texts = np.zeros(n, np.int64), np.zeros(n, np.int64), [], []
        for i, (a, b) in enumerate(zip(p.offs[:-1].tolist(), p.offs[1:].tolist())):
            cut, text = gone[a:b], p.raw[a:b]
            n_removed[i] = np.count_nonzero(cut)
            n_spans[i] = np.count_nonzero(cut[1:] & ~cut[:-1]) + int(b > a and cut[0])
            digest.append(hashlib.sha256(text[~cut].tobytes() if n_removed[i] else text.tobytes()).hexdigest())
            if with_text:
                texts.append(whole_characters(text, cut) if n_removed[i] else text.tobytes().decode())
        cols = [*[table.column(f"__{c}").combine_chunks() for c in keep], pa.array(np.diff(p.offs)), pa.array(n_removed), pa.array(n_spans), pa.array(digest, pa.string())]
        names = [*keep, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if with_text:
            cols, names = [*cols, pa.array(texts, pa.string())], [*names, "kept_text"]
        yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols], names)

    entry = "bucket long, block long, blob binary"
    first = materialize(bl.merge(bl.visit(packed, None, report_phrases, entry), sort_dictionary), "phrase-answers")
    second = materialize(bl.merge(bl.visit(packed, first, report_parts, entry), sort_suffixes), "suffix-answers")
    own = StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_text string" if with_text else ""))
    schema = StructType([*[StructField(c, docs.schema[c].dataType) for c in keep], *own.fields])
    return bl.visit(packed, first.union(second), lay_over, schema)


def whole_characters(text: np.ndarray, cut: np.ndarray) -> str:
    """The text without characters all of whose bytes are cut."""
    start = np.flatnonzero((text & 0xC0) != 0x80)
    kept = np.add.reduceat((~cut).astype(np.int64), start) > 0
    size = np.diff(np.append(start, len(text)))
    return text[np.repeat(kept, size)].tobytes().decode()
