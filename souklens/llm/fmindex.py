"""Benchmark decontamination with one FM-index per training shard.

A shard is a block of training texts. Its words become symbols of the benchmark's vocabulary; a word
that no benchmark window has becomes a separator, and runs of symbols too short for any window are
left out, neither of which loses an occurrence. Over the rest stands an FM-index: Burrows-Wheeler
transform, symbol counts, wavelet-matrix ranks and suffix positions sampled every ``SAMPLE`` symbols.
All windows are searched backwards at once, occurrences are located by walking to a sampled position,
and their words are merged into removal spans.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souklens.functions.storage import materialise
from souklens.llm import textbytes as tb

WINDOW = 10
SAMPLE = 16
#: Benchmark text that is sent to the executors at once; a larger benchmark is searched in blocks.
BENCHMARK_BYTES = 8 << 20


class Windows:
    """Windows of some benchmark items: word numbers by length, and the items each window belongs to."""

    def __init__(self, items: list[tuple[str, str]], size: int = WINDOW):
        vocabulary: dict[bytes, int] = {}
        owners: dict[tuple, set[str]] = defaultdict(set)
        for item, text in items:
            block = next(tb.blocks(pa.array([text])))
            _, _, codes, distinct = block_words(block)
            own = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in distinct]
            words = [own[c] for c in codes.tolist()]
            n = min(size, len(words))
            for i in range(len(words) - n + 1 if n else 0):
                owners[tuple(words[i:i + n])].add(item)
        windows = sorted(owners)
        self.vocabulary = vocabulary
        self.items = sorted({i for x in owners.values() for i in x})
        place = {x: i for i, x in enumerate(self.items)}
        self.shortest = min(map(len, windows), default=0)
        self.by_length = {}
        for n in sorted({len(x) for x in windows}):
            own = [x for x in windows if len(x) == n]
            symbols = np.array(own, np.int64)
            lists = [sorted(place[i] for i in owners[x]) for x in own]
            self.by_length[n] = symbols, np.array([i for x in lists for i in x], np.int64), np.cumsum([0] + [len(x) for x in lists])

    def symbols(self, codes: np.ndarray, distinct: list[bytes]) -> np.ndarray:
        """The vocabulary's number of each word, 0 for other words."""
        known = self.vocabulary
        return np.array([known.get(w, 0) for w in distinct], np.int64)[codes] if len(codes) else codes


def block_words(block: tb.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Starts and ends of words, a code of each by its bytes, and the distinct words."""
    data = tb.FOLD[block.data]
    starts, ends = tb.spans(tb.ALNUM[data], block.offsets)
    return starts, ends, *tb.distinct(data, starts, ends)


class FmIndex:
    """Index of a symbol sequence in which 0 separates runs and ends the last one."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        self.n = n
        order = suffix_order(text)
        self.last = text[order - 1]  # the symbol before each suffix; before the first stands a separator
        top = int(text.max()) + 1
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top))])
        # wavelet matrix: from the highest bit on, stable split by the bit; counts of ones before each place
        self.levels, rest = [], self.last
        for bit in range(max(1, (top - 1).bit_length()) - 1, -1, -1):
            ones = (rest >> bit) & 1
            before = np.zeros(n + 1, np.int32)
            np.cumsum(ones, out=before[1:])
            self.levels.append((bit, before, n - int(before[-1])))
            rest = np.concatenate([rest[ones == 0], rest[ones == 1]])
        sampled = np.arange(n) % SAMPLE == 0
        sampled[1:] |= text[:-1] == 0  # a walk never crosses a separator
        sampled[0] = True
        self.known = np.where(sampled[order], order, -1)

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often ``symbol[i]`` stands before ``place[i]`` in the transform."""
        low, high = np.zeros_like(place), place.copy()
        for bit, before, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            a, b = before[low], before[high]
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return high - low

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of ``patterns`` that occur, and their intervals of suffixes, by backward search."""
        alive = np.arange(len(patterns))
        low, high = self.less[patterns[:, -1]], self.less[patterns[:, -1] + 1]
        for j in range(patterns.shape[1] - 2, -1, -1):
            keep = high > low
            alive, low, high = alive[keep], low[keep], high[keep]
            if not len(alive):
                break
            symbol = patterns[alive, j]
            low, high = self.less[symbol] + self.rank(symbol, low), self.less[symbol] + self.rank(symbol, high)
        keep = high > low
        return alive[keep], low[keep], high[keep]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: steps back by the last-to-first map until a sampled one."""
        out, steps, open_ = np.full(len(rows), -1), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(open_):
            at = self.known[rows[open_]]
            out[open_] = np.where(at >= 0, at + steps, -1)
            open_ = open_[at < 0]
            symbol = self.last[rows[open_]]
            rows[open_] = self.less[symbol] + self.rank(symbol, rows[open_])
            steps += 1
        return out


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by doubling; separators count as different symbols, in order of place."""
    n = len(text)
    gaps = text == 0
    rank = np.where(gaps, np.cumsum(gaps) - 1, int(gaps.sum()) + text - 1)
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[:n - step] = rank[step:] + 1
        key = rank * np.int64(2 * n + int(text.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        fresh = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])])
        if fresh[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        step *= 2


def occurrences(windows: Windows, symbols: np.ndarray, first: np.ndarray):
    """For each window length: word positions, the length, and the windows that occur there.

    ``first`` gives the first word of each text and the number of words.
    """
    if not windows.shortest or not len(symbols):
        return
    offsets = first
    starts, ends = tb.spans(symbols > 0, offsets)
    wide = ends - starts >= windows.shortest
    starts, ends = starts[wide], ends[wide]
    if not len(starts):
        return
    sizes = ends - starts + 1
    places = tb.ragged(sizes, starts)  # word of each symbol; the place after a run is its separator
    text = np.zeros(len(places), np.int64)
    inside = np.ones(len(places), bool)
    inside[np.cumsum(sizes) - 1] = False
    used, dense = np.unique(symbols[places[inside]], return_inverse=True)
    text[inside] = dense + 1
    index = FmIndex(text)
    for n, (patterns, _, _) in windows.by_length.items():
        at = np.minimum(np.searchsorted(used, patterns), len(used) - 1)
        there = np.flatnonzero((used[at] == patterns).all(axis=1))
        if not len(there):
            continue
        found, low, high = index.search(at[there] + 1)
        if len(found):
            rows = tb.ragged(high - low, low)
            yield places[index.locate(rows)], n, np.repeat(there[found], high - low)


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", keep: list[str] = ("doc_id",), item_col: str = "item_id", item_text: str = "text",
         cleaned: bool = False, size: int = WINDOW, benchmark_bytes: int = BENCHMARK_BYTES) -> DataFrame:
    """Benchmark passages in every text: the columns of ``keep`` and

    * ``n_words``, ``n_hit`` (words inside any occurrence of a window), ``contaminated``,
    * ``items``: ids, as strings, of the items with an occurring window, sorted,
    * ``spans``: removal spans, maximal runs of hit words as (start, end) word positions,
    * ``cleaned``, if asked for: the text without its removal spans, a line break in place of each.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after folding A-Z; a window is ``size`` consecutive
    words of an item, or the whole of a shorter item. Null and empty texts have no words, an item
    without words or with a null id has no window; rows that repeat an item id are one item; an empty
    benchmark marks nothing. Repeated rows of ``docs`` are each returned.
    """
    bench = benchmark.select(benchmark[item_col].cast("string").alias("id"), benchmark[item_text].alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(total / benchmark_bytes))
    bench = bench.withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(parts)))
    out = docs
    for part in range(parts):
        rows = bench.filter(F.col("part") == part).select("id", "text").collect() if parts > 1 else bench.select("id", "text").collect()
        shared = docs.sparkSession.sparkContext.broadcast(Windows([(r["id"], r["text"]) for r in rows], size))
        carried = list(keep) + ([text_col] if part < parts - 1 and text_col not in keep else [])
        out = _pass(out, text_col, carried, shared, cleaned and part == parts - 1, part > 0)
        if part < parts - 1:
            out = materialise(out)
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def _pass(docs: DataFrame, text_col: str, keep: list[str], shared, cleaned: bool, again: bool) -> DataFrame:
    """Searches one block of the benchmark and adds what earlier passes found."""

    def work(block: tb.Block, found: list) -> dict:
        windows = shared.value
        starts, ends, codes, distinct = block_words(block)
        first = np.searchsorted(starts, block.offsets)
        hit = np.zeros(len(codes) + 1, np.int32)
        pairs = []
        for at, n, window in occurrences(windows, windows.symbols(codes, distinct), first):
            np.add.at(hit, at, 1)
            np.add.at(hit, at + n, -1)
            pair = np.unique(np.stack([np.searchsorted(first, at, side="right") - 1, window], axis=1), axis=0)
            _, items, bounds = windows.by_length[n]
            sizes = bounds[pair[:, 1] + 1] - bounds[pair[:, 1]]
            pairs.append(np.stack([np.repeat(pair[:, 0], sizes), items[tb.ragged(sizes, bounds[pair[:, 1]])]], axis=1))
        names = [set() for _ in range(len(block))]
        if pairs:
            for doc, item in np.unique(np.concatenate(pairs), axis=0).tolist():
                names[doc].add(windows.items[item])
        if found:
            for i, (before, spans) in enumerate(zip(found[0].to_pylist(), found[1].to_pylist())):
                names[i].update(before)
                for s in spans:
                    hit[first[i] + s["start"]] += 1
                    hit[first[i] + s["end"]] -= 1
        low, high = tb.spans(np.cumsum(hit[:-1]) > 0, first)
        doc = np.searchsorted(first, low, side="right") - 1
        base = first[doc]
        counts = np.zeros(len(block) + 1, np.int32)
        np.add.at(counts, doc + 1, 1)
        n_hit = np.zeros(len(block), np.int64)
        np.add.at(n_hit, doc, high - low)
        runs = pa.StructArray.from_arrays([pa.array(low - base, pa.int64()), pa.array(high - base, pa.int64())], ["start", "end"])
        out = {"n_words": np.diff(first), "n_hit": n_hit, "items": pa.array([sorted(x) for x in names], pa.list_(pa.string())),
               "spans": pa.ListArray.from_arrays(np.cumsum(counts, dtype=np.int32), runs)}
        if cleaned:
            texts = [block.text(i) for i in range(len(block))]
            edges = np.searchsorted(doc, np.arange(len(block) + 1))
            for i in np.flatnonzero(n_hit).tolist():
                at, pieces = block.offsets[i], []
                for k in range(edges[i], edges[i + 1]):
                    pieces.append(block.data[at:starts[low[k]]].tobytes())
                    at = ends[high[k] - 1]
                texts[i] = b"\n".join(pieces + [block.data[at:block.offsets[i + 1]].tobytes()])
            out["cleaned"] = pa.array(texts, pa.binary()).cast(pa.string())
        return out

    schema = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>" + ", cleaned string" * cleaned
    return tb.map_texts(docs, text_col, keep, schema, work, ["items", "spans"] if again else [])


def remove(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **names) -> DataFrame:
    """``docs`` with the benchmark passages cut out of ``text_col``; other columns and rows stay.

    A null text stays null. A text goes to the workers once and comes back once, with or without passages.
    """
    others, absent = [c for c in docs.columns if c != text_col], "_absent"
    marked = docs.withColumns({text_col: docs[text_col], absent: docs[text_col].isNull()})
    out = scan(marked, benchmark, text_col, keep=others + [absent], cleaned=True, **names)
    text = F.when(~F.col(absent), F.col("cleaned"))
    return out.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns], "n_hit")
