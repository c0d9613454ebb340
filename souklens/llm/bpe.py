"""Byte-level BPE: encoding by a prefix-sharing walk over distinct words, and decoding.

Every prefix of a word has one encoding, and the encoding of a prefix without its last token is that
of the shorter prefix. So one state, the last token, is kept for each prefix: of the tokens that end
the prefix the right one is that which the BPE merges leave apart from the last token before it.
Distinct words are walked in sorted order, which is the depth-first order of their trie, and the
states of a shared prefix are computed once.
"""

from __future__ import annotations

import hashlib
import json
import pickle
import zlib
from array import array
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souklens.functions.storage import materialise
from souklens.llm import textbytes as tb

#: Words whose ids a worker remembers, and checked token pairs and automaton steps; beyond it a memory starts anew.
REMEMBERED, REMEMBERED_PAIRS = 150_000, 300_000
#: Size of the table of frequent pre-tokens, and of the summary that a task keeps to find them.
FREQUENT, SUMMARY, FREQUENT_BYTES = 16_384, 65_536, 64
#: Bytes of text that are encoded and decoded at once: a block's arrays take up to 40 times as much.
ROUND_TRIP_BYTES = 512 << 10

OTHER, LETTER, NUMBER, SPACE, SPECIAL, UNKNOWN = range(6)


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


NO_MERGE = 1 << 62


class Merges:
    """Merge ranks of token pairs in two sorted arrays, a tenth of what a dict of tuples takes."""

    def __init__(self, pairs: list[tuple[int, int]], made: list[int]):
        keys = np.array([a << 20 | b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = array("q", keys[order].tobytes()), array("i", order.astype(np.int32).tobytes())
        self.made = array("i", made)

    def find(self, a: int, b: int) -> int:
        key = a << 20 | b
        at = bisect_left(self.keys, key)
        return self.ranks[at] if at < len(self.keys) and self.keys[at] == key else NO_MERGE


class Bpe:
    """A byte-level BPE tokenizer read from the bytes of a ``tokenizers`` JSON file."""

    def __init__(self, raw: bytes):
        from tokenizers import Tokenizer

        spec = json.loads(raw)
        self._library = Tokenizer.from_str(raw.decode()).pre_tokenizer
        alphabet = byte_alphabet()
        as_bytes = lambda t: bytes(alphabet[c] for c in t)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens: list[bytes] = [b""] * size
        for t, i in vocab.items():
            if t.encode() not in self.special:
                self.tokens[i] = as_bytes(t)
        for t, i in self.special.items():
            self.tokens[i] = t
        ids = {t: i for i, t in enumerate(self.tokens) if t and t not in self.special}
        self.byte_ids = [ids[bytes([b])] for b in range(256)]
        merges = spec["model"].pop("merges")
        pairs = [[as_bytes(x) for x in (pair if isinstance(pair, list) else pair.split(" "))] for pair in merges]
        self.merges = Merges([(ids[a], ids[b]) for a, b in pairs], [ids[a + b] for a, b in pairs])
        del spec, vocab, merges, pairs
        self.lengths = np.array([len(t) for t in self.tokens])
        self._sizes = array("i", self.lengths.astype(np.int32).tobytes())
        self._flat = np.frombuffer(b"".join(self.tokens), np.uint8)
        self._starts = np.cumsum(self.lengths) - self.lengths
        self._build_suffixes(ids)
        self._apart: dict[int, bool] = {}
        self._known: dict[bytes, bytes] = {}
        self._classes = np.full(0x110000, UNKNOWN, np.uint8)
        self.classify(np.arange(128))

    def packed(self) -> bytes:
        """The tables without what has been met so far, for ``unpacked``: 0.1 s and 23 MB at most, building them takes 4 s and 67 MB."""
        return zlib.compress(pickle.dumps(self.__dict__ | {"_apart": {}, "_known": {}, "_steps": {}}, pickle.HIGHEST_PROTOCOL), 1)

    @classmethod
    def unpacked(cls, data: bytes) -> Bpe:
        bpe = cls.__new__(cls)
        bpe.__dict__ = pickle.loads(zlib.decompress(data))
        return bpe

    # -- plain merging, for single tokens and for pairs of tokens

    def merged(self, text: bytes) -> list[int]:
        """BPE by its definition: the pair of lowest rank first, the leftmost of equal ones."""
        parts = [self.byte_ids[b] for b in text]
        find = self.merges.find
        ranks = [find(a, b) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == NO_MERGE:
                break
            i = ranks.index(best)
            parts[i:i + 2] = [self.merges.made[best]]
            del ranks[i]
            if i:
                ranks[i - 1] = find(parts[i - 1], parts[i])
            if i < len(ranks):
                ranks[i] = find(parts[i], parts[i + 1])
        return parts

    def apart(self, a: int, b: int) -> bool:
        """Whether ``a b`` is the encoding of their joined bytes."""
        return self.merged(self.tokens[a] + self.tokens[b]) == [a, b]

    # -- which tokens end at a byte: the automaton of all tokens

    def _build_suffixes(self, ids: dict[bytes, int]) -> None:
        """Tables of the automaton as flat arrays: children by (node, byte), failure links, and the tokens that end at a node.

        ``_own`` is the token of a node or -1, ``_near`` the nearest node with a token on the way of failure
        links, the node itself included, and ``_up`` the next one after a node with a token.
        """
        child, token, depth = {}, [-1], [0]
        for t, i in ids.items():
            node = 0
            for b in t:
                key = node << 8 | b
                to = child.get(key)
                if to is None:
                    to = child[key] = len(token)
                    token.append(-1)
                    depth.append(depth[node] + 1)
                node = to
            token[node] = i
        keys = np.fromiter(child.keys(), np.int64, len(child))
        nodes = np.fromiter(child.values(), np.int32, len(child))
        order = np.argsort(keys)
        self._keys, self._nodes = array("q", keys[order].tobytes()), array("i", nodes[order].tobytes())
        n = len(token)
        self._fail, self._own, self._near, self._up = (array("i", bytes(4 * n)) for _ in range(4))
        self._own[0] = -1
        for at in np.argsort(np.array(depth)[nodes], kind="stable").tolist():  # shorter prefixes first
            key, node = int(keys[at]), int(nodes[at])
            if depth[node] > 1:
                self._fail[node] = self._step(self._fail[key >> 8], key & 255)
            i, fail = token[node], self._fail[node]
            good = i >= 0 and (depth[node] == 1 or self.merged(self.tokens[i]) == [i])
            self._own[node] = i if good else -1
            self._near[node] = node if good else self._near[fail]
            self._up[node] = self._near[fail]
        self._steps: dict[int, int] = {}

    def _step(self, node: int, byte: int) -> int:
        while True:
            key = node << 8 | byte
            at = bisect_left(self._keys, key)
            if at < len(self._keys) and self._keys[at] == key:
                return self._nodes[at]
            if not node:
                return 0
            node = self._fail[node]

    # -- distinct words

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each distinct word as little-endian 32-bit integers, in the words' order."""
        known = self._known
        if len(known) + len(words) > REMEMBERED:
            known.clear()
        new = sorted(w for w in words if w not in known)
        if new:
            self._walk(new)
        return [known[w] for w in words]

    def _walk(self, words: list[bytes]) -> None:
        known, special, steps, apart = self._known, self.special, self._steps, self._apart
        own, near, up = self._own, self._near, self._up
        lengths = self._sizes
        if len(apart) > REMEMBERED_PAIRS:
            apart.clear()
        if len(steps) > REMEMBERED_PAIRS:
            steps.clear()
        before = b""
        last, nodes = [-1], [0]  # of each prefix of the word before: its last token, its automaton state
        for word in words:
            if word in special:
                known[word] = np.array([special[word]], "<u4").tobytes()
                continue
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1:], nodes[shared + 1:]
            node = nodes[-1]
            for end in range(shared + 1, len(word) + 1):
                key = node << 8 | word[end - 1]
                to = steps.get(key)
                if to is None:
                    to = steps[key] = self._step(node, word[end - 1])
                node = to
                at = near[node]
                while True:
                    t = own[at]
                    n = lengths[t]
                    if n == end:
                        break
                    left = last[end - n]
                    pair = left << 20 | t
                    ok = apart.get(pair)
                    if ok is None:
                        ok = apart[pair] = self.apart(left, t)
                    if ok:
                        break
                    at = up[at]
                last.append(t)
                nodes.append(node)
            ids, at = [], len(word)
            while at:
                ids.append(last[at])
                at -= lengths[last[at]]
            known[word] = np.array(ids[::-1], "<u4").tobytes()
            before = word

    # -- texts

    def classify(self, points: np.ndarray) -> None:
        """Asks the library's own splitting for the class of characters not met before."""
        spans_of = lambda s: len(self._library.pre_tokenize_str(s))
        for p in points.tolist():
            c = chr(p)
            found = next((k for k, probe in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if spans_of(probe + c) == 1), SPACE)
            self._classes[p] = found

    def _byte_classes(self, data: np.ndarray) -> np.ndarray:
        kinds = self._classes[data]  # right for ASCII; lead bytes and what follows them are set below
        lead = np.flatnonzero(data >= 0xC0)
        if not len(lead):
            return kinds
        b0 = data[lead].astype(np.int64)
        size = 2 + (b0 >= 0xE0) + (b0 >= 0xF0)
        point = np.where(size == 2, b0 & 31, np.where(size == 3, b0 & 15, b0 & 7))
        for j in (1, 2, 3):
            more = size > j
            point[more] = point[more] << 6 | data[lead[more] + j] & 63
        seen = np.unique(point)
        self.classify(seen[self._classes[seen] == UNKNOWN])
        kind = self._classes[point]
        kinds[lead] = kind
        for j in (1, 2, 3):
            more = size > j
            kinds[lead[more] + j] = kind[more]
        return kinds

    def pretokens(self, block: tb.Block) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pre-tokens of all texts; special strings are pre-tokens of their own.

        The same as splitting by ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``:
        runs of one class, of which a run before a word or sign gives its last blank to it.
        """
        data, offsets = block.data, block.offsets
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        kinds = self._byte_classes(data)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        fresh = edge[:n].copy()
        raw = data.tobytes()
        for text in self.special:
            at = raw.find(text)
            while at >= 0:
                if not edge[at + 1:at + len(text)].any():
                    kinds[at:at + len(text)] = SPECIAL
                    fresh[at] = True
                    if at + len(text) < n:
                        fresh[at + len(text)] = True
                    at = raw.find(text, at + len(text))
                else:
                    at = raw.find(text, at + 1)
        fresh[1:] |= kinds[1:] != kinds[:-1]
        start = np.flatnonzero(fresh)
        end = np.append(start[1:], n)
        kind = kinds[start]
        follows = np.append(kind[1:], SPECIAL)
        follows[edge[end]] = SPECIAL  # nothing follows at the end of a text
        s, e = start.copy(), end.copy()

        blank = np.flatnonzero((kind == SPACE) & (follows < SPACE))
        tail = end[blank] - 1
        for _ in range(3):
            tail -= (data[tail] & 0xC0) == 0x80
        given = data[tail] == 32
        e[blank] = tail
        s[blank[given] + 1] = tail[given]
        alone = tail[~given], end[blank[~given]]

        mark = np.flatnonzero((kind == OTHER) & (end - start == 1) & (data[start] == 39) & (s == start) & (follows == LETTER))
        one = data[start[mark] + 1]
        two = np.where(end[np.minimum(mark + 1, len(end) - 1)] > start[mark] + 2, data[np.minimum(start[mark] + 2, n - 1)], 0)
        single = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        double = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
        taken = np.where(single, 1, np.where(double, 2, 0))
        e[mark] += taken
        s[np.minimum(mark + 1, len(s) - 1)] += taken

        s, e = np.concatenate([s, alone[0]]), np.concatenate([e, alone[1]])
        real = e > s
        return np.sort(s[real]), np.sort(e[real])

    def distinct(self, block: tb.Block):
        """Distinct pre-tokens of a block: their bytes, the place of each pre-token's word, and starts."""
        starts, ends = self.pretokens(block)
        codes, words = tb.distinct(block.data, starts, ends)
        return words, codes, starts

    def encode(self, block: tb.Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one text after another, and the offsets between texts."""
        words, inverse, starts = self.distinct(block)
        coded = self.encode_words(words)
        sizes = np.array([len(c) >> 2 for c in coded], np.int64)
        flat = np.frombuffer(b"".join(coded), "<u4")
        begin = np.cumsum(sizes) - sizes
        each = sizes[inverse]
        ids = flat[tb.ragged(each, begin[inverse])]
        return ids, np.concatenate([[0], np.cumsum(each)])[np.searchsorted(starts, block.offsets)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of id lists: the tokens' bytes, undecodable ones replaced."""
        each = self.lengths[ids]
        raw = self._flat[tb.ragged(each, self._starts[ids])].tobytes()
        cuts = np.concatenate([[0], np.cumsum(each)])[offsets].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:])]


_BUILT: dict[bytes, Bpe] = {}
#: Of the driver: the tables of the tokenizer file last used, by the file's digest.
_PACKED: dict[bytes, bytes] = {}


def worker_bpe(shared: tuple[bytes, bytes]) -> Bpe:
    """The tokenizer of this worker process, unpacked once."""
    key, tables = shared
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Bpe.unpacked(tables)
    tb.keeps("bpe", _BUILT.clear)
    return _BUILT[key]


def shared_tables(docs: DataFrame, path: str):
    """The tokenizer's tables (2 MB here), built from its file by the driver: executors need no copy of it and build nothing."""
    with open(path, "rb") as f:
        raw = f.read()
    key = hashlib.sha256(raw).digest()
    if key not in _PACKED:
        _PACKED.clear()
        _PACKED[key] = Bpe(raw).packed()
    return docs.sparkSession.sparkContext.broadcast((key, _PACKED[key]))


def encode(docs: DataFrame, path: str, text_col: str = "text", keep: list[str] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``ids array<int>`` of every text; a null or empty text has no ids.

    As the library encodes without added special tokens, truncation and padding. Rows stay as given.
    """
    tables = shared_tables(docs, path)

    def work(block: tb.Block) -> dict:
        ids, offsets = worker_bpe(tables.value).encode(block)
        return {"ids": pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(ids.astype(np.int32)))}

    return tb.map_texts(docs, text_col, list(keep), "ids array<int>", work, owner="bpe")


def decode(coded: DataFrame, path: str, ids_col: str = "ids", keep: list[str] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``text``, decoded from ``ids_col``; null and empty id lists give an empty text."""
    tables = shared_tables(coded, path)
    slots = [f"k{i}" for i in range(len(keep))]
    inner = coded.select(*[coded[c].alias(s) for c, s in zip(keep, slots)], F.coalesce(coded[ids_col], F.array().cast("array<int>")).alias("ids"))

    def run(batches):
        for batch in batches:
            lists = batch.column(len(slots))
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = np.diff(lists.offsets.to_numpy())
            for a in range(0, batch.num_rows, 1000):
                part = sizes[a:a + 1000]
                begin = int(sizes[:a].sum())
                texts = worker_bpe(tables.value).decode(ids[begin:begin + int(part.sum())], np.concatenate([[0], np.cumsum(part)]))
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(a, len(part)) for i in range(len(slots))] + [pa.array(texts, pa.string())], names=slots + ["text"])

    made = inner.mapInArrow(run, ", ".join([f"{s} {coded.schema[c].dataType.simpleString()}" for s, c in zip(slots, keep)] + ["text string"]))
    return made.select(*[made[s].alias(c) for s, c in zip(slots, keep)], "text")


def round_trip(docs: DataFrame, path: str, text_col: str = "text", keep: list[str] = ("doc_id",)) -> DataFrame:
    """Encodes and decodes every text: ``keep``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``, ``same``.

    ``same`` says whether decoding gave the text back. Ids stay in the worker: only their digest moves.
    """
    tables = shared_tables(docs, path)

    def work(block: tb.Block) -> dict:
        bpe = worker_bpe(tables.value)
        ids, offsets = bpe.encode(block)
        texts = [t.encode() for t in bpe.decode(ids, offsets)]
        cuts = offsets.tolist()
        coded = ids.astype("<u4")
        return {"n_tokens": np.diff(offsets), "ids_sha256": [hashlib.sha256(coded[a:b].tobytes()).hexdigest() for a, b in zip(cuts[:-1], cuts[1:])],
                "decoded_sha256": [hashlib.sha256(t).hexdigest() for t in texts], "same": [t == block.text(i) for i, t in enumerate(texts)]}

    return tb.map_texts(docs, text_col, list(keep), "n_tokens long, ids_sha256 string, decoded_sha256 string, same boolean", work, owner="bpe", limit=ROUND_TRIP_BYTES)


# -- token counts with two tiers


def frequent(docs: DataFrame, path: str, text_col: str = "text", size: int = FREQUENT) -> list[tuple[bytes, int]]:
    """The most frequent pre-tokens of all texts and how many tokens each has.

    Each task counts the pre-tokens of its texts in a summary of bounded size (beyond it, the rarest
    go and may come back) and gives on its ``size`` most frequent; only these summaries are shuffled.
    The table speeds counting up and never changes a count.
    """
    tables = shared_tables(docs, path)
    texts = docs.select(docs[text_col].cast("string").alias("t"))

    def run(batches):
        bpe, seen = worker_bpe(tables.value), {}
        for batch in batches:
            for block in tb.blocks(batch.column(0)):
                words, codes, _ = bpe.distinct(block)
                for w, c in zip(words, np.bincount(codes, minlength=len(words)).tolist()):
                    if c > 1 and len(w) <= FREQUENT_BYTES:
                        seen[w] = seen.get(w, 0) + c
                if len(seen) > SUMMARY:
                    seen = dict(sorted(seen.items(), key=lambda x: -x[1])[:SUMMARY // 2])
        top = sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:size]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.binary()), pa.array([c for _, c in top], pa.int64())], names=["word", "n"])

    counted = texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = materialise(counted)
    # where to cut: a histogram of the counts, so that no more than the table comes to the driver
    steps = counted.groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.count("*").alias("k"), F.min("n").alias("n")).orderBy(F.desc("step")).collect()
    least, taken = None, 0
    for step in steps:
        if taken + step["k"] > size:
            break
        least, taken = step["n"], taken + step["k"]
    words = [] if least is None else [bytes(r["word"]) for r in counted.filter(F.col("n") >= least).collect()]
    return [(w, len(c) >> 2) for w, c in zip(words, worker_bpe(tables.value).encode_words(words))]


class FirstTier:
    """Token counts of frequent pre-tokens, by their bytes."""

    def __init__(self, table: list[tuple[bytes, int]]):
        self.counts = dict(table)

    def look_up(self, words: list[bytes]) -> np.ndarray:
        """Counts, 0 where the table hasn't got the word."""
        return np.array([self.counts.get(w, 0) for w in words], np.int64)


def token_counts(docs: DataFrame, path: str, text_col: str = "text", keep: list[str] = ("doc_id",), limit: int = 1024, size: int = FREQUENT) -> DataFrame:
    """``keep``, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more tokens than ``limit``) of every text.

    Map-side only: frequent pre-tokens are looked up in a broadcast table of at most ``size`` entries,
    others are encoded and kept in the worker's own memory, so no pre-token is shuffled. A null or
    empty text has 0 bytes and tokens. Rows stay as given.
    """
    tables = shared_tables(docs, path)
    tier = docs.sparkSession.sparkContext.broadcast(FirstTier(frequent(docs, path, text_col, size)))

    def work(block: tb.Block) -> dict:
        bpe = worker_bpe(tables.value)
        words, inverse, starts = bpe.distinct(block)
        counts = tier.value.look_up(words)
        missed = np.flatnonzero(counts == 0)
        coded = bpe.encode_words([words[i] for i in missed.tolist()])
        counts[missed] = [len(c) >> 2 for c in coded]
        sums = np.concatenate([[0], np.cumsum(counts[inverse])])
        n = np.diff(sums[np.searchsorted(starts, block.offsets)])
        return {"n_bytes": np.diff(block.offsets), "n_tokens": n, "over_limit": n > limit}

    return tb.map_texts(docs, text_col, list(keep), "n_bytes long, n_tokens long, over_limit boolean", work, owner="bpe")
