"""Subword tokenizers behind the token hooks: ids of texts (U3), line truncation by any token count.

Both run in Arrow batches. A tokenizer is loaded once a Python worker and kept for its
later tasks. Texts become Python strings and go through it in runs of bounded size, lists of ids are
Arrow lists built from one flat array and offsets, and freed memory goes back to the system after
each batch. The ids of several tokenizers of one table are made in one worker a task.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator, Sequence
from contextlib import suppress
from functools import partial
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from prefspark.functions.chat import TLDR_SUFFIX

RUN_CHARS = 1 << 20          # characters that go through a tokenizer at once
_loaded: dict[str, LibraryTokenizer] = {}


class TokenCounter(Protocol):
    """What B8 needs of a tokenizer."""

    def counts(self, texts: Sequence[str]) -> Sequence[int]:
        """Tokens of each text."""

    def least(self, text: str, ends: Sequence[int]) -> Sequence[int]:
        """For each end: a number that ``text[:end]`` has at least as tokens (0 where nothing is certain)."""


class LibraryTokenizer:
    """A model file of the tokenizers library, without truncation, padding and special tokens around a text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")      # tasks are the parallelism
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    @classmethod
    def load(cls, path: str) -> LibraryTokenizer:
        """One instance a path and Python worker."""
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def ids(self, texts: Sequence[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch(list(texts), add_special_tokens=False)]

    def counts(self, texts: Sequence[str]) -> list[int]:
        return [len(e) for e in self.model.encode_batch(list(texts), add_special_tokens=False)]

    def measured(self, texts: Sequence[str]) -> list[tuple[int, Callable[[Sequence[int]], np.ndarray]]]:
        """Tokens of each text with its ``least``, from one encoding."""
        return [(len(e), partial(self._least, e)) for e in self.model.encode_batch(list(texts), add_special_tokens=False)]

    def least(self, text: str, ends: Sequence[int]) -> np.ndarray:
        """Tokens of the pieces (of the pre-tokenizer) that are over before the end.

        A piece depends on the text before it, itself and the character after it, and
        is tokenized by itself, so it is the same in the shorter text."""
        return self._least(self.model.encode(text, add_special_tokens=False), ends)

    def _least(self, e, ends: Sequence[int]) -> np.ndarray:
        if self.model.pre_tokenizer is None:
            return np.zeros(len(ends), np.int64)
        stop = np.array([b for _, b in e.offsets], np.int64)
        if not len(stop):
            return np.zeros(len(ends), np.int64)
        piece = np.array([-1 if w is None else w for w in e.word_ids], np.int64)
        first = np.flatnonzero(np.append(True, (piece[1:] != piece[:-1]) | (piece[1:] < 0)))
        over = np.maximum.accumulate(np.maximum.reduceat(stop, first))
        return np.searchsorted(np.repeat(over, np.diff(np.append(first, len(stop)))), np.asarray(ends), "left")


def runs(texts: Sequence[str], most: int = RUN_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges of about ``most`` characters; a longer text stands alone."""
    a, size = 0, 0
    for k, t in enumerate(texts):
        if k > a and size + len(t) > most:
            yield a, k
            a, size = k, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


def text_runs(batch: pa.Array, most: int = RUN_CHARS) -> Iterator[list[str]]:
    """The texts of a string array (null: empty) in runs of about ``most`` bytes; a longer text stands alone."""
    size = pc.binary_length(batch).fill_null(0).to_numpy(zero_copy_only=False)
    total, a = np.cumsum(size, dtype=np.int64), 0
    while a < len(total):
        b = max(a + 1, int(np.searchsorted(total, total[a] - size[a] + most, "right")))
        yield batch.slice(a, b - a).fill_null("").to_pylist()
        a = b


def release() -> None:
    """Give freed memory back to the system: a Python worker is kept for later tasks."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):                  # not the GNU C library
        ctypes.CDLL(None).malloc_trim(0)


# ---------------------------------------------------------------- U3


def id_lists(batch: pa.Array, ids: Callable[[Sequence[str]], list[list[int]]]) -> pa.Array:
    """Token ids of a string array as a list array; a null text has no tokens."""
    flat, sizes = [], [0]
    for texts in text_runs(batch):
        some = ids(texts)
        sizes += [len(x) for x in some]
        flat.append(np.fromiter((i for x in some for i in x), np.int32))
    values = np.concatenate(flat) if flat else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(values))


def library_ids(text: str | Column, path: str) -> Column:
    """Ids of a text by a model file of the tokenizers library (array<int>; a null text has none).

    No iterator of batches: Spark gives each such function a Python worker of its own."""
    @F.arrow_udf(ArrayType(IntegerType()))
    def encode(batch: pa.Array) -> pa.Array:
        out = id_lists(batch, LibraryTokenizer.load(path).ids)
        release()
        return out

    return encode(F.col(text) if isinstance(text, str) else text)


def library_counter(path: str) -> Callable[[Column], Column]:
    """The same tokenizer as the counter hook of the length filters (a null text has no tokens)."""
    @F.arrow_udf(IntegerType())
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = LibraryTokenizer.load(path)
        for batch in batches:
            texts = batch.fill_null("").to_pylist()
            yield pa.array([n for a, b in runs(texts) for n in model.counts(texts[a:b])], pa.int32())

    return count


# ---------------------------------------------------------------- B8


def measured(counter: TokenCounter, texts: Sequence[str]) -> Sequence[tuple[int, Callable[[Sequence[int]], Sequence[int]]]]:
    """Tokens of each text with its ``least``: by the counter's own ``measured`` if it has one, which needs one pass."""
    if hasattr(counter, "measured"):
        return counter.measured(texts)
    return [(n, partial(counter.least, t)) for n, t in zip(counter.counts(texts), texts)]


def longest_fitting(texts: Sequence[str], limit: int, counter: TokenCounter) -> list[str]:
    """Each text without as many of its last lines as it takes to have ``limit`` tokens or fewer.

    Prefixes are tried from the longest on, since fewer lines may well have more tokens.
    Those that ``least`` rules out aren't tokenized; the others go through the tokenizer
    together with those of the other texts, one of each text at first, then two, four and so on."""
    out = list(texts)
    left: dict[int, list[int]] = {}
    for a, b in runs(texts):
        for k, (n, bound) in enumerate(measured(counter, texts[a:b]), a):
            if n > limit:
                text, ends, at = texts[k], [], len(texts[k])
                while (at := text.rfind("\n", 0, at)) >= 0:
                    ends.append(at)
                ends.append(0)                              # no line at all: the last resort, whatever it counts
                left[k] = [e for e, m in zip(ends, bound(ends)) if m <= limit or e == 0]
    width = 1
    while left:
        asked = [(k, e) for k, ends in left.items() for e in ends[:width]]
        fits: dict[int, int] = {}
        tried = [texts[k][:e] for k, e in asked]
        for a, b in runs(tried):
            for (k, e), n in zip(asked[a:b], counter.counts(tried[a:b])):
                if n <= limit or e == 0:
                    fits[k] = max(e, fits.get(k, 0))
        for k, e in fits.items():
            out[k] = texts[k][:e]
        left = {k: ends[width:] for k, ends in left.items() if k not in fits}
        width *= 2
    return out


def truncate_lines_by(text: str | Column, limit: int, make_counter: Callable[[], TokenCounter], suffix: str = TLDR_SUFFIX) -> Column:
    """B8 for any tokenizer: trailing lines go until the text has ``limit`` tokens or fewer, then ``suffix`` follows.

    ``make_counter`` is called once a task. A null text stays null; a text none of whose line
    prefixes fits becomes the suffix alone."""
    @F.arrow_udf(StringType())
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = make_counter()
        for batch in batches:
            texts = batch.fill_null("").to_pylist()
            kept = [t + suffix for a, b in runs(texts, 8 * RUN_CHARS) for t in longest_fitting(texts[a:b], limit, counter)]
            yield pa.array(kept, pa.string(), mask=np.array(batch.is_null()))

    return cut(F.col(text) if isinstance(text, str) else text)


def truncate_lines_library(df: DataFrame, col: str, limit: int, path: str, suffix: str = TLDR_SUFFIX, out: str | None = None) -> DataFrame:
    """B8 with a model file of the tokenizers library: ``out`` (by default ``col``) is the truncated text."""
    return df.withColumn(out or col, truncate_lines_by(F.col(f"`{col}`"), limit, lambda: LibraryTokenizer.load(path), suffix))
