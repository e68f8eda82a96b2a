"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The words (matches of the pattern) of a block of documents form a corpus: each distinct
word is laid out once, byte by byte, in one long linked list. An inverted index
maps each rank to the positions where a pair of neighbours would merge into that token. The replay
takes ranks from a heap in order, merges at every position of that rank from left to
right, and updates the index only for the two neighbours it touched. Words
that a worker has replayed stay in a bounded cache, so a word frequent in the corpus is replayed
once in each worker. Documents then join their words' ids.

A merge can make a pair whose rank is lower than the one at hand. In a word of its own it
would be taken next, before the other positions of the present rank; such words (marked as they
arise) are encoded one by one instead. A word that is itself a token is that token.

Encoding and decoding are narrow passes; ids travel as packed little-endian unsigned 32-bit
integers (`unpacked` turns them into an array). `round_trip` does both in one worker: two
functions in a row would keep two Python workers on each core. The ranks file is read by the driver
and broadcast; a ranks file is of a fixed size (50,256 entries here).

Memory of a worker: the ranks and their pairs (about 40 MB), a cache of words of at most `CACHE_BYTES`,
emptied when full and at the end of a task, and one block of documents, whose equal words are one object.

Defined cases: null and empty texts have no ids and decode to empty bytes; no special
tokens are known, their strings are ordinary text. Texts are encoded whole; repeated rows alike; extra columns
pass through, those named like an output are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, table

#: Bytes of words, ids and their dictionary entries in a worker's cache at most, about; it is emptied when full.
CACHE_BYTES = 40_000_000
#: Bytes of an entry beside those of the word and its ids: two objects' heads and a place in the dictionary.
ENTRY_BYTES = 190
#: Characters of the documents that make up one corpus, about; more is faster and takes more memory.
BLOCK_CHARS = 2_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank, from lines of base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def splitter(pattern: str):
    r"""text -> its matches. Python's own `re` is several times as fast as `regex`.

    So the classes \p{L}, \p{N}, \s and \S are written out for it as ranges of the basic
    plane; a text with characters beyond that goes to `regex`.
    """
    anywhere = regex.compile(pattern).findall
    ranges = {}
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        test = regex.compile(name).match
        codes = np.array([c for c in range(0x10000) if not 0xD800 <= c < 0xE000 and test(chr(c))])
        runs = np.split(codes, np.flatnonzero(np.diff(codes) != 1) + 1)
        ranges[name] = "".join(f"\\u{r[0]:04x}-\\u{r[-1]:04x}" for r in runs)
    out, depth, i = "", 0, 0
    while i < len(pattern):
        name = next((k for k in (*ranges, r"\S") if pattern.startswith(k, i)), None)
        depth += {"[": 1, "]": -1}.get(pattern[i], 0)
        if name == r"\S":
            out += f"[^{ranges[chr(92) + 's']}]"
        elif name:
            out += ranges[name] if depth else f"[{ranges[name]}]"
        else:
            out += pattern[i]
        i += len(name or "x")
    inside = re.compile(out).findall
    beyond = re.compile("[\U00010000-\U0010ffff]").search
    return lambda text: anywhere(text) if beyond(text) else inside(text)


class Decoder:
    """All tokens' bytes in a row, and where each begins."""

    def __init__(self, ranks: dict[bytes, int]):
        by_rank = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            by_rank[rank] = token
        self.blob = np.frombuffer(b"".join(by_rank), np.uint8)
        self.size = np.array([len(t) for t in by_rank])
        self.at = np.cumsum(self.size) - self.size

    def decode(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, "<u4")
        size = self.size[ids]
        total = int(size.sum())
        return self.blob[np.repeat(self.at[ids] - (np.cumsum(size) - size), size) + np.arange(total)].tobytes()


class MergeReplay:
    """Encodes words of one vocabulary, in corpora."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = splitter(pattern)
        self.packed: dict[str, bytes] = {}
        self.cached = 0
        self.decode = Decoder(ranks).decode
        # Two neighbours (a << 20 | b) -> the rank of both as one token; the same as sorted arrays.
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    self.pairs[a << 20 | b] = rank
        self.keys = np.sort(np.fromiter(self.pairs, np.int64, len(self.pairs)))
        self.values = np.array([self.pairs[k] for k in self.keys.tolist()])
        self.single = np.array([ranks[bytes([b])] for b in range(256)])

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of pairs of neighbours as one token, or -1 (also next to a gap)."""
        key = np.where((a < 0) | (b < 0), -1, a << 20 | b)
        near = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[near] == key, self.values[near], -1)

    def one_word(self, word: bytes) -> list[int]:
        """Lowest rank first, leftmost of equals, until no pair merges."""
        ids, pairs = self.single[list(word)].tolist(), self.pairs
        while len(ids) > 1:
            merges = [(r, i) for i in range(len(ids) - 1) if (r := pairs.get(ids[i] << 20 | ids[i + 1], -1)) >= 0]
            if not merges:
                break
            rank, at = min(merges)
            ids[at : at + 2] = [rank]
        return ids

    def replay(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of each word of a corpus of distinct, non-empty words."""
        if not words:
            return []
        # One list for all words, with a gap (-1) before, between and after them.
        size = np.array([len(w) for w in words])
        starts = np.cumsum(size + 1) - size
        flat = np.frombuffer(b"\0" + b"\0".join(words) + b"\0", np.uint8)
        tok = self.single[flat]
        tok[starts - 1] = tok[-1] = -1
        nxt, prv = np.arange(1, len(tok) + 1), np.arange(-1, len(tok) - 1)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []
        odd: list[np.ndarray] = []

        def add(ranks: np.ndarray, places: np.ndarray) -> None:
            """Enter places into the index, by rank."""
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
            for rank, a, b in zip(ranks[cuts[:-1]].tolist(), cuts, cuts[1:]):
                if rank in index:
                    index[rank].append(places[a:b])
                else:
                    index[rank] = [places[a:b]]
                    heapq.heappush(heap, rank)

        # What each token would become with the next one.
        with_next = np.append(self.merged(tok[:-1], tok[1:]), -1)
        found = np.flatnonzero(with_next >= 0)
        if len(found):
            add(with_next[found], found)
        while heap:
            rank = heapq.heappop(heap)
            lists = index.pop(rank)
            p = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            p = p[with_next[p] == rank]  # others were touched since
            if len(p) > 1 and (overlap := nxt[p[:-1]] == p[1:]).any():
                # Of places in a row every second one, from the left.
                head = np.concatenate(([True], ~overlap))
                number = np.arange(len(p))
                p = p[(number - np.maximum.accumulate(np.where(head, number, 0))) % 2 == 0]
            if not len(p):
                continue
            q = nxt[p]
            tok[p], tok[q] = rank, -2
            nxt[p] = after = nxt[q]
            prv[after] = p
            before = prv[p]
            with_next[q] = -1
            places = np.concatenate((before, p))
            ranks = self.merged(tok[places], tok[np.concatenate((p, after))])
            with_next[places] = ranks
            new = ranks >= 0
            if new.any():
                places, ranks = places[new], ranks[new]
                if (ranks < rank).any():
                    odd.append(places[ranks < rank])
                add(ranks, places)
        ends = np.cumsum(tok >= 0)
        first, last = (ends[starts - 1] * 4).tolist(), (ends[starts + size - 1] * 4).tolist()
        packed = tok[tok >= 0].astype("<u4").tobytes()
        out = [packed[a:b] for a, b in zip(first, last)]
        if odd:
            for k in np.unique(np.searchsorted(starts, np.concatenate(odd), side="right") - 1).tolist():
                out[k] = np.array(self.one_word(words[k]), "<u4").tobytes()
        return out

    def learn(self, words: set[str]) -> None:
        """Put the packed ids of words into the cache."""
        todo, raws = [], []
        for w in words:
            raw = w.encode("utf-8", "replace")
            rank = self.ranks.get(raw)
            if rank is None:
                todo.append(w)
                raws.append(raw)
            else:
                self.packed[w] = rank.to_bytes(4, "little")
        self.packed.update(zip(todo, self.replay(raws)))

    def encode(self, texts: list) -> list[bytes]:
        """Packed ids of each text of a block."""
        same: dict[str, str] = {}
        split = [[same.setdefault(w, w) for w in self.split(t)] if isinstance(t, str) else [] for t in texts]
        new = {w for w in same if w not in self.packed}
        size = sum(map(len, new)) * 3 + ENTRY_BYTES * len(new)
        if self.cached + size > CACHE_BYTES:
            self.forget()
            new = set(same)
        self.cached += size
        self.learn(new)
        get = self.packed.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def forget(self) -> None:
        """Empty the cache of words."""
        self.packed, self.cached = {}, 0


_WORKER: dict[str, MergeReplay | Decoder] = {}


def _kept(shared) -> MergeReplay | Decoder:
    """This worker's own of the broadcast ranks and pattern, kept from task to task; a decoder where no pattern is given."""
    ranks, pattern, name = shared.value
    if name not in _WORKER:
        _WORKER.clear()
        _WORKER[name] = MergeReplay(ranks, pattern) if pattern else Decoder(ranks)
    return _WORKER[name]


def _shared(spark, ranks_path: str, pattern: str | None):
    """Broadcast the ranks under a name that tells their content and the pattern."""
    ranks = read_ranks(ranks_path)
    content = b"".join(t for t, _ in sorted(ranks.items(), key=lambda x: x[1]))
    name = hashlib.sha256(content + str(pattern).encode()).hexdigest()
    return spark.sparkContext.broadcast((ranks, pattern, name))


def in_parts(values: list, sizes: list[int]) -> Iterator[pd.Series]:
    at = 0
    for n in sizes:
        yield pd.Series(values[at : at + n], dtype=object)
        at += n


def _blocks(parts: Iterator[pd.Series], replay: MergeReplay) -> Iterator[pd.Series]:
    """The packed ids of each part, worked out by block."""
    block: list = []
    sizes: list[int] = []
    chars = 0
    for part in parts:
        block += list(part)
        sizes.append(len(part))
        chars += sum(len(t) for t in part if isinstance(t, str))
        if chars >= BLOCK_CHARS:
            yield from in_parts(replay.encode(block), sizes)
            block, sizes, chars = [], [], 0
    yield from in_parts(replay.encode(block), sizes)
    replay.forget()


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """docs with n_tokens and ids (packed)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = _shared(spark, ranks_path, pattern)

    @F.pandas_udf("binary")
    def encoded(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from _blocks(texts, _kept(shared))

    out = docs.drop("ids", "n_tokens").withColumn("ids", encoded(F.col(text_col)))
    return out.withColumn("n_tokens", _n_tokens())


def _n_tokens() -> Column:
    return F.expr("octet_length(ids) div 4").cast("long")


def decode(docs: DataFrame, ranks_path: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """docs with the bytes of packed ids."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = _shared(spark, ranks_path, None)

    @F.pandas_udf("binary")
    def decoded(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = _kept(shared)
        for part in ids:
            yield pd.Series([decoder.decode(x) if x is not None else None for x in part], dtype=object)

    return docs.withColumn(into, decoded(F.col(ids_col)))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """docs with n_tokens, ids (packed) and decoded, the bytes that the ids stand for."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = _shared(spark, ranks_path, pattern)

    @F.pandas_udf("ids binary, decoded binary")
    def both(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        replay = _kept(shared)
        for ids in _blocks(texts, replay):
            yield pd.DataFrame({"ids": ids, "decoded": pd.Series([replay.decode(x) for x in ids], dtype=object)})

    out = docs.drop("ids", "n_tokens", "decoded").withColumn("_both", both(F.col(text_col)))
    return out.withColumn("ids", F.col("_both.ids")).withColumn("decoded", F.col("_both.decoded")).drop("_both").withColumn("n_tokens", _n_tokens())


def unpacked(ids_col: str = "ids") -> Column:
    """Packed ids as an array of ints."""

    @F.pandas_udf("array<int>")
    def as_array(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: np.frombuffer(x, "<u4").astype(np.int32))

    return as_array(F.col(ids_col))


def op6_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs, ranks, public_tokenizers.PATTERN).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
