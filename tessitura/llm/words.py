"""Column-wise work on the words of many texts: each distinct word of a batch is looked at once."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters of text that are worked on at once in a Python worker.
CHUNK = 2_000_000


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The rows in pieces of about `limit` bytes of text, a longer text alone; order is kept."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        at, total = 0, 0
        for i, n in enumerate(size):
            if total and total + n > limit:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += int(n)
        if at < batch.num_rows:
            yield batch.slice(at)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, and at a task's end what it has freed goes back to the system: workers wait for their next task beside those of
    other stages."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return task


def release() -> None:
    """What this process has freed goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def spread(per_word: list, index: np.ndarray, offsets: np.ndarray, dtype=np.int32) -> tuple[np.ndarray, np.ndarray]:
    """per_word: a sequence of numbers for each distinct word, or its bytes; index: the distinct word at each place;
    offsets: where each text begins among the places. The numbers of all texts in a row, and where each text begins among them."""
    lens = np.fromiter(map(len, per_word), np.int64, len(per_word))
    if per_word and isinstance(per_word[0], bytes):
        flat = np.frombuffer(b"".join(per_word), dtype)
        lens = lens // flat.itemsize
    else:
        flat = np.fromiter(chain.from_iterable(per_word), dtype, int(lens.sum()))
    starts = np.cumsum(lens) - lens
    n = lens[index]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    take = np.repeat(starts[index] - (ends - n), n) + np.arange(total)
    return flat[take], np.concatenate([[0], ends])[offsets]


def split(texts: pa.Array, newline: bool = True) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts cut at spaces and line feeds (null: empty): distinct words, their index at each place, text offsets."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if newline:
        texts = pc.replace_substring(texts, "\n", " ")
    lists = pc.split_pattern(texts, " ")
    return coded(lists)


def coded(lists: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    offsets = lists.offsets.to_numpy().astype(np.int64)
    words = lists.flatten().dictionary_encode()
    return words.dictionary.to_pylist(), words.indices.to_numpy().astype(np.int64), offsets - offsets[0]


class Cache:
    """What `work` gives for words, kept between batches for the first `limit` distinct ones: frequent words come early."""

    def __init__(self, work: Callable[[list[str]], list], limit: int = 400_000):
        self.work, self.limit, self.known = work, limit, {}

    def get(self, words: list[str]) -> list:
        known = self.known
        out = [known.get(w) for w in words]
        missing = [i for i, x in enumerate(out) if x is None]
        if missing:
            made = self.work([words[i] for i in missing])
            for i, x in zip(missing, made):
                out[i] = x
                if len(known) < self.limit:
                    known[words[i]] = x
        return out
