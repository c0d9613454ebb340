"""Vector work on the UTF-8 bytes of many texts at once.

An Arrow string column is one byte buffer with offsets. Words, lines and pre-tokens are spans of
that buffer; spans are found, told apart by their bytes and hashed for a whole block of texts with a
few array passes, so Python runs at most once for each distinct word. A block holds at most ``BLOCK_BYTES`` of text, or a single longer text.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

BLOCK_BYTES = 2 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: Folds A-Z to a-z and leaves every other byte.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after folding.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

#: Bytes of words ``[^\x20\x09-\x0D]+``.
SOLID = np.ones(256, bool)
SOLID[[32, 9, 10, 11, 12, 13]] = False


class Block:
    """Texts ``first`` to ``first + len`` of a batch: their bytes and the offsets between them."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()

    def owner(self, starts: np.ndarray) -> np.ndarray:
        """The text that each position lies in."""
        return np.searchsorted(self.offsets, starts, side="right") - 1


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cuts a string column into blocks of whole texts; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, off, data = column.buffers()
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(off, np.int64)[column.offset:column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield Block(i, raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
        i = j


def spans(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True, cut where a text ends."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    step = np.empty(len(mask) + 1, np.int8)
    step[0], step[-1] = mask[0], -np.int8(mask[-1])
    np.subtract(mask[1:], mask[:-1], out=step[1:-1], dtype=np.int8)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(mask))]
    cut = np.unique(cut[mask[cut] & mask[cut - 1]])
    if len(cut):
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of a 64-bit value over all 64 bits (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """A code for each span, and the distinct spans in order of their codes; told apart by their bytes, not by hashes.

    Spans are in order and don't overlap.
    """
    if not len(starts):
        return np.zeros(0, np.int64), []
    lengths = ends - starts
    if (starts[1:] == ends[:-1]).all():
        raw = data[starts[0]:ends[-1]]
    else:
        inside = np.zeros(len(data) + 1, np.int8)
        real = lengths > 0
        inside[starts[real]] += 1
        inside[ends[real]] -= 1
        raw = data[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()


def hash_words(words: list[bytes]) -> np.ndarray:
    """64-bit hashes, the same in every block and process. They find candidates; what a result depends on compares bytes."""
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)


def dense(columns: list[np.ndarray]) -> np.ndarray:
    """A code for each row of columns of codes, the same for equal rows and for no others."""
    key, width = columns[0].astype(np.int64), int(columns[0].max(initial=0)) + 1
    for column in columns[1:]:
        n = int(column.max(initial=0)) + 1
        if width * n > 1 << 62:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            width = int(key.max(initial=0)) + 1
        key = key * n + column
        width *= n
    return np.unique(key, return_inverse=True)[1].astype(np.int64)


_KEPT: dict[str, Callable[[], None]] = {}


def keeps(owner: str, forget: Callable[[], None]) -> None:
    """Notes that ``owner`` keeps something in this worker; work of other owners may drop it."""
    _KEPT[owner] = forget


def give_back(owner: str | None = None) -> None:
    """Before and after a task: drops what others keep in the worker and returns freed memory to the system.

    Workers live on between stages, and what one stage left would stand beside the next one's needs. Arrays
    get pages of their own (the C library would otherwise raise its limit for that to 32 MB, and what is
    freed between other things in its heap can't be given back).
    """
    for name in [n for n in _KEPT if n != owner]:
        _KEPT.pop(name)()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(_OWN_PAGES, OWN_PAGES_BYTES)
        libc.malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: M_MMAP_THRESHOLD of the C library (a fixed value), and from which size on allocations get pages of their own.
_OWN_PAGES, OWN_PAGES_BYTES = -3, 1 << 20


def ragged(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions of ``lengths[i]`` values from ``starts[i]``, one run after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


#: Bytes of text that Spark hands to Python at once, unless the session says otherwise.
BATCH_BYTES = 8 << 20
_SETTING, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", ("67108864", "67108864b", "64m", "64MB")


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches from Spark's default of 64 MB: long texts then need less memory."""
    if spark.conf.get(_SETTING, None) in _DEFAULT:
        spark.conf.set(_SETTING, str(BATCH_BYTES))


def map_texts(df: DataFrame, text: str, keep: list[str], schema: str, work: Callable[..., dict], uses: list[str] | None = None, owner: str | None = None, limit: int = BLOCK_BYTES) -> DataFrame:
    """Runs ``work`` on each block of ``text``; ``work`` gives one value per text for each new column.

    ``keep`` names the columns that are carried through; no other column is read, but for those in
    ``uses``: ``work`` gets them as a second argument, Arrow arrays of the block's rows. ``owner`` names
    what ``work`` keeps in the worker for later tasks, see ``keeps``; ``limit`` is the size of a block.
    """
    small_batches(df.sparkSession)
    kept = [df[c] for c in keep]
    slots = [f"k{i}" for i in range(len(keep))]
    inner = df.select(*[c.alias(s) for c, s in zip(kept, slots)], df[text].cast("string").alias("t"), *[df[c].alias(f"u{i}") for i, c in enumerate(uses or [])])
    takes = [len(slots) + 1 + i for i in range(len(uses or []))]
    names = [part.split()[0].strip("`") for part in split_schema(schema)]

    def run(batches):
        give_back(owner)
        for batch in batches:
            if not batch.num_rows:
                continue
            for block in blocks(batch.column(len(slots)), limit):
                out = work(block, [batch.column(i).slice(block.first, len(block)) for i in takes]) if uses is not None else work(block)
                head = [batch.column(i).slice(block.first, len(block)) for i in range(len(slots))]
                yield pa.RecordBatch.from_arrays(head + [pa.array(out[n]) if not isinstance(out[n], pa.Array) else out[n] for n in names], names=slots + names)
        give_back(owner)

    fields = [f"{s} {df.schema[c].dataType.simpleString()}" for s, c in zip(slots, keep)]
    made = inner.mapInArrow(run, ", ".join(fields + [schema]))
    return made.select(*[made[s].alias(c) for s, c in zip(slots, keep)], *[made[n] for n in names])


def plain_columns(df: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with columns c0, c1, ... that clash with no operator's own, and the way back to its names."""
    names = df.columns
    back = lambda rows: rows.select(*[rows[f"c{i}"].alias(n) for i, n in enumerate(names)])
    return df.toDF(*[f"c{i}" for i in range(len(names))]), back


def split_schema(schema: str) -> list[str]:
    """The columns of a DDL string; commas inside <> don't count."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[start:i].strip())
            start = i + 1
    return out + [schema[start:].strip()]
