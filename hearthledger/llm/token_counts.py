r"""Token counts by a tokenizer compiled to finite-state transducers.

Two deterministic machines count the tokens of a byte-level BPE tokenizer without
making them:

* The *splitter* reads character classes (letters, digits, spaces, apostrophes, ...) and emits
  where words begin, as the pattern
  `'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+` would. It has 13 states, and
  emissions wait one character where the pattern looks ahead. A block of
  texts is cut into chunks of `CHUNK` characters. Each chunk is first run from all 13 states at
  once: that is its state map. A parallel prefix scan composes the maps, which gives
  every chunk its true first state; a second run emits the word starts.
* The *counter* reads the bytes of a word. Each transition is annotated with the
  change in the number of tokens. Its states are what the tokens to come can depend on: the longest suffix
  that begins some token, and for each place in it where a token can begin, the
  last token before that place and the tokens since. A token follows another only
  if the pair encodes to itself. Transitions are compiled when first met and kept by
  the worker; all words of a block advance together, one byte at a time. Words of more than `LONG_WORD` bytes
  are cut into chunks that advance together too: the state maps of the chunks are composed along the word (`Counter.composed`).

Counting is one narrow pass. The special string of the tokenizer is one token wherever it
occurs, as the library treats it by default. Defined cases: null and empty texts have no tokens;
texts are counted whole; repeated rows alike; extra columns pass through, those named like an
output are replaced.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, table

CHUNK = 256
#: Characters that are counted together at most, but for a single longer text.
BLOCK_CHARS = 2_000_000
#: Bytes beyond which a word is read in chunks, bytes of such a chunk, and bytes before it from which its first state is guessed.
LONG_WORD, WORD_CHUNK, WARM = 1024, 512, 48
#: Compiled states of a worker (about 0.5 KB each); beyond it starts anew.
MAX_STATES = 400_000

STATES = ("start", "end", "letters", "digits", "other", "apo", "apo_r", "apo_v", "apo_l", "sp", "sps", "ws", "wss")
CLASSES = ("letter", "stmd", "r", "v", "l", "e", "digit", "sp", "ws", "apo", "other", "reset")


def _splitter_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """next state, word starts here, word started one character before; by state * classes + class."""
    state = {s: i for i, s in enumerate(STATES)}
    nxt, here, before = (np.zeros((len(STATES), len(CLASSES)), np.uint8) for _ in range(3))
    run = {"digit": "digits", "sp": "sp", "ws": "ws", "apo": "apo", "other": "other"}
    for s in STATES:
        for k, c in enumerate(CLASSES):
            letter = k < 6
            to, h, b = "letters" if letter else run.get(c, "start"), 1, 0
            joined = "other" if c == "apo" else to  # an apostrophe after a space or symbol is no contraction
            if c == "reset":
                b = int(s in ("apo_r", "apo_v", "apo_l"))
            elif s == "letters":
                h = int(not letter)
            elif s == "digits":
                h = int(c != "digit")
            elif s == "other":
                if c in ("apo", "other"):
                    to, h = "other", 0
            elif s == "apo":
                if c == "stmd":
                    to, h = "end", 0
                elif c in ("r", "v", "l"):
                    to, h = f"apo_{c}", 0
                elif c in ("apo", "other"):
                    to, h = "other", 0
            elif s in ("apo_r", "apo_v", "apo_l"):
                if c == ("l" if s == "apo_l" else "e"):
                    to, h = "end", 0
                else:
                    h, b = int(not letter), 1
            elif s in ("sp", "ws", "sps", "wss"):
                if c in ("sp", "ws"):
                    to, h = "sps" if c == "sp" else "wss", 0
                else:
                    b = int(s in ("sps", "wss"))
                    if s in ("sp", "sps"):
                        to, h = joined, 0
            nxt[state[s], k], here[state[s], k], before[state[s], k] = state[to], h, b
    return nxt.ravel(), here.ravel(), before.ravel()


def _class_table() -> np.ndarray:
    """Code point -> class."""
    codes = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    out = np.full(0x110000, CLASSES.index("other"), np.uint8)
    for name, cls in ((r"\p{L}+", "letter"), (r"\p{N}+", "digit"), (r"\s+", "ws")):
        for m in regex.finditer(name, codes):
            out[ord(m[0][0]) : ord(m[0][-1]) + 1] = CLASSES.index(cls)
    out[0xD800:0xE000] = CLASSES.index("other")
    for chars, cls in (("stmd", "stmd"), ("r", "r"), ("v", "v"), ("l", "l"), ("e", "e"), (" ", "sp"), ("'", "apo")):
        for ch in chars:
            out[ord(ch)] = CLASSES.index(cls)
    return out


class Splitter:
    def __init__(self):
        self.next, self.here, self.before = _splitter_tables()
        self.classes = _class_table()

    def starts(self, cls: np.ndarray) -> np.ndarray:
        """Whether a word starts at each character of a block of classes."""
        n, k, q = len(cls), len(CLASSES), len(STATES)
        padded = np.full(-(-(n + 1) // CHUNK) * CHUNK, CLASSES.index("reset"), np.uint8)
        padded[:n] = cls
        columns = np.ascontiguousarray(padded.reshape(-1, CHUNK).T).astype(np.int16)
        # The state map of each chunk: where each of the states leads.
        maps = np.tile(np.arange(q, dtype=np.uint8), (columns.shape[1], 1))
        for c in columns:
            maps = self.next[maps * np.int16(k) + c[:, None]]
        # Composed by doubling: afterwards a map is that of all chunks up to its own.
        step = 1
        while step < len(maps):
            maps[step:] = np.take_along_axis(maps[step:], maps[:-step].copy(), axis=1)
            step *= 2
        state = np.concatenate(([0], maps[:-1, 0])).astype(np.int16)
        here, before = np.empty(columns.shape, np.uint8), np.empty(columns.shape, np.uint8)
        for j, c in enumerate(columns):
            at = state * np.int16(k) + c
            here[j], before[j], state = self.here[at], self.before[at], self.next[at].astype(np.int16)
        flags = here.T.ravel().astype(bool)
        flags[:-1] |= before.T.ravel()[1:].astype(bool)
        return flags[:n]


def _byte_of() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Counter:
    """The transducer over the bytes of a word, compiled step by step."""

    def __init__(self, merges: list[tuple[str, str]]):
        byte = _byte_of()
        raw = {}
        to_bytes = lambda s: raw.setdefault(s, bytes(byte[c] for c in s))
        self.ranks = {(to_bytes(a), to_bytes(b)): i for i, (a, b) in enumerate(merges)}
        self.vocab = {bytes([b]) for b in range(256)} | {a + b for a, b in self.ranks}
        self.heads = {t[:i] for t in self.vocab for i in range(len(t))}
        self.pairs: dict[tuple, bool] = {}
        self.reset()

    def reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.size = 0
        self.bits = 16
        self.slots()
        self.state((b"", ((0, None, 0),)))

    def slots(self) -> None:
        """An empty hash table of transitions: state * 256 + byte -> next state, change in tokens."""
        self.at = np.full(1 << self.bits, -1, np.int64)
        self.next = np.zeros(1 << self.bits, np.int32)
        self.delta = np.zeros(1 << self.bits, np.int8)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or the free slot where it would go."""
        mask = (1 << self.bits) - 1
        slot = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        todo = np.flatnonzero((self.at[slot] != keys) & (self.at[slot] >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & mask
            there = self.at[slot[todo]]
            todo = todo[(there != keys[todo]) & (there >= 0)]
        return slot

    def put(self, key: int, to: int, delta: int) -> None:
        if 2 * self.size >= len(self.at):
            old = [x.tolist() for x in (self.at, self.next, self.delta)]
            self.bits += 2
            self.size = 0
            self.slots()
            for k, t, d in zip(*old):
                if k >= 0:
                    self.put(k, t, d)
        slot = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 64 - self.bits
        while self.at[slot] >= 0:
            slot = (slot + 1) & (1 << self.bits) - 1
        self.at[slot], self.next[slot], self.delta[slot] = key, to, delta
        self.size += 1

    def state(self, key: tuple) -> int:
        if key not in self.ids:
            self.ids[key] = len(self.keys)
            self.keys.append(key)
        return self.ids[key]

    def tokens(self, word: bytes) -> list[bytes]:
        """The merges in rank order, leftmost first."""
        out = [word[i : i + 1] for i in range(len(word))]
        while len(out) > 1:
            found = [(r, i) for i in range(len(out) - 1) if (r := self.ranks.get((out[i], out[i + 1]))) is not None]
            if not found:
                break
            i = min(found)[1]
            out[i : i + 2] = [out[i] + out[i + 1]]
        return out

    def follows(self, last: bytes | None, token: bytes) -> bool:
        """Whether token can come right after last: both together encode to just these two."""
        key = (last, token)
        if key not in self.pairs:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            self.pairs[key] = self.tokens(token if last is None else last + token) == [*filter(None, [last]), token]
        return self.pairs[key]

    def compile(self, state: int, byte: int) -> None:
        """The transition of a state on a byte."""
        head, places = self.keys[state]
        grown = head + bytes([byte])
        n = len(head)
        # The places run from the longest suffix to the shortest; one token alone fits.
        last, delta = next(
            (grown[n - k :], since + 1)
            for k, before, since in places
            if grown[n - k :] in self.vocab and self.follows(before, grown[n - k :])
        )
        at = {k: (before, since) for k, before, since in places}
        tail = next(grown[i:] for i in range(len(grown) + 1) if grown[i:] in self.heads)
        kept = [(k, *at[k - 1]) for k in range(len(tail), 0, -1) if tail[len(tail) - k :] in self.heads]
        key = (tail, (*((k, before, since - delta) for k, before, since in kept), (0, last, 0)))
        self.put(state * 256 + byte, self.state(key), delta)

    def run(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last state, change in tokens) of each piece data[begin:end] read from its own first state; all advance together."""
        size = end - begin
        order = np.argsort(-size, kind="stable")
        begin, size, state = begin[order], size[order], state[order].astype(np.int64)
        total = np.zeros(len(order), np.int64)
        longest = int(size[0]) if len(size) else 0
        active = np.searchsorted(-size, -np.arange(longest), side="left")
        for j in range(longest):
            m = active[j]
            keys = state[:m] * 256 + data[begin[:m] + j]
            slot = self.find(keys)
            if (missing := self.at[slot] < 0).any():
                for at in np.unique(keys[missing]).tolist():
                    self.compile(*divmod(at, 256))
                slot = self.find(keys)
            total[:m] += self.delta[slot]
            state[:m] = self.next[slot]
        last, out = np.empty_like(state), np.empty_like(total)
        last[order], out[order] = state, total
        return last, out

    def counts(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of tokens of each word data[begin:end]."""
        if len(self.keys) > MAX_STATES:
            self.reset()
        long = end - begin > LONG_WORD
        out = np.zeros(len(begin), np.int64)
        out[~long] = self.run(data, begin[~long], end[~long], np.zeros((~long).sum(), np.int64))[1]
        if long.any():
            out[long] = self.composed(data, begin[long], end[long])
        return out

    def composed(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """counts of long words, chunk by chunk.

        Each chunk has a map from first states to its last state and its tokens. It starts with the state that the `WARM` bytes before
        the chunk lead to from a fresh start, as machines soon forget where they began. The scan then follows the maps along each word; chunks whose
        true first state is not in their map are run from it, all at once, until every word is followed to its end.
        """
        n = -(-(end - begin) // WORD_CHUNK)
        word = np.repeat(np.arange(len(begin)), n)
        nth = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
        start = begin[word] + nth * WORD_CHUNK
        stop = np.minimum(start + WORD_CHUNK, end[word])
        first = nth == 0
        state = np.zeros(len(word), np.int64)
        state[~first] = self.run(data, start[~first] - WARM, start[~first], np.zeros((~first).sum(), np.int64))[0]
        last, total = self.run(data, start, stop, state)
        while True:
            true = np.where(first, 0, np.roll(last, 1))
            other = np.flatnonzero(true != state)
            if not len(other):
                return np.bincount(word, total, len(begin)).astype(np.int64)
            state[other] = true[other]
            last[other], total[other] = self.run(data, start[other], stop[other], state[other])


class TokenCounter:
    def __init__(self, merges: list, special: list[str]):
        self.splitter, self.counter = Splitter(), Counter(merges)
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def count(self, texts: list) -> list[int]:
        """Tokens of each text of a block."""
        totals = np.zeros(len(texts), np.int64)
        parts, owner = [], []
        for i, text in enumerate(texts):
            if isinstance(text, str) and text:
                text = text.encode("utf-8", "replace").decode("utf-8")
                pieces = self.special.split(text) if self.special else [text]
                totals[i] += len(pieces) - 1
                parts += pieces
                owner += [i] * len(pieces)
        if not parts:
            return totals.tolist()
        joined = "\n".join([*parts, ""])
        size = np.array([len(p) + 1 for p in parts])
        cls = self.splitter.classes[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
        gaps = np.cumsum(size) - 1
        cls[gaps] = CLASSES.index("reset")
        starts = np.flatnonzero(self.splitter.starts(cls))
        data = np.frombuffer(joined.encode("utf-8"), np.uint8)
        offset = np.flatnonzero((data & 0xC0) != 0x80)
        begin = offset[starts]
        end = np.append(begin[1:], len(data))
        word = cls[starts] != CLASSES.index("reset")
        counts = self.counter.counts(data, begin[word], end[word])
        whose = np.array(owner)[np.searchsorted(gaps, starts[word])]
        return (totals + np.bincount(whose, counts, len(texts)).astype(np.int64)).tolist()


_WORKER: dict[str, TokenCounter] = {}


def checked(spec: dict) -> tuple[list[tuple[str, str]], list[str]]:
    """(merges, special strings) of a tokenizer's JSON; an error for what these transducers do not model."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "ignore_merges"))
    if not plain or spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        raise ValueError("only byte-level BPE without a normalizer, prefix space or options of its own is counted")
    merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    return merges, [t["content"] for t in spec["added_tokens"]]


def count_tokens(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """docs with n_bytes and n_tokens."""
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        raw = f.read()
    # A worker keeps its counter under the file's digest: another broadcast of the same file finds it again, one of another file does not.
    shared = spark.sparkContext.broadcast((hashlib.sha256(raw.encode()).hexdigest(), *checked(json.loads(raw))))

    @F.pandas_udf("long")
    def counted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        name, *made_of = shared.value
        if name not in _WORKER:
            _WORKER.clear()
            _WORKER[name] = TokenCounter(*made_of)
        counter = _WORKER[name]
        for part in texts:
            out: list[int] = []
            block: list = []
            chars = 0
            for text in part:
                block.append(text)
                chars += len(text) if isinstance(text, str) else 0
                if chars >= BLOCK_CHARS:
                    out += counter.count(block)
                    block, chars = [], 0
            yield pd.Series(out + counter.count(block), dtype="int64")

    out = docs.drop("n_bytes", "n_tokens")
    out = out.withColumn("n_bytes", F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long"))
    return out.withColumn("n_tokens", counted(F.col(text_col)))


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))
