"""BPE encoding and decoding, with a segment tree over the ranks of adjacent pairs.

A word is a row of symbols; leaf i of its tree holds the rank of the pair (i, next symbol), and each inner node the
least key below it, a key being rank and place together. So the root names the leftmost pair of the lowest rank. A
merge changes two pairs and removes one: three point updates of logarithmic depth. It goes on until the root holds no
pair. Many words of like length are advanced together as rows of one numpy array, a merge in each per step; a few, and
so very long ones, have a tree each in plain lists, where a merge takes microseconds instead of an array call's price.

Texts are normalised and cut into words as the vocabulary file says; the ids of up to 100,000 words of 64 characters at
most (some 30 MB) are kept in a table for each worker, so a common word is merged once. Every whole text is encoded.

Null text: empty, no ids. Repeated rows all stay; an empty table gives no rows. Extra columns stay as they are; those
whose names clash with the added ones are replaced.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from lanewright.llm.common import in_batches

NONE = np.int64(1) << 62
ADDED = ("n_tokens", "ids_sha256", "decoded_sha256")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Ids, merges and cutting rules of a word-end BPE vocabulary file."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        model, ids = spec["model"], spec["model"]["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t.encode() for t, i in [*ids.items(), *self.special.items()]}
        symbols = byte_symbols()
        self.first = np.array([ids[s] for s in symbols], np.int64)
        self.last = np.array([ids[s + suffix] for s in symbols], np.int64)
        rows = [(ids[a] << 20 | ids[b], rank, ids[a + b]) for rank, (a, b) in enumerate(model["merges"])]
        rows.sort()
        keys, ranks, made = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        last = np.append(keys[1:] != keys[:-1], True)  # of a pair listed twice the later rank counts
        self.keys, self.ranks, self.made = keys[last], ranks[last], made[last]
        self.slots = _table(self.keys)
        self._merges: dict[int, tuple[int, int]] = {}
        self.words = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.narrow = _narrow(self.words.pattern)
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.starts = sorted({t[0] for t in self.special})

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The index among the merges of each pair of ids, or -1."""
        key = left << 20 | right
        at = _slot(key, len(self.slots))
        found = np.full(len(key), -1, np.int64)
        open_ = np.arange(len(key))
        while len(open_):
            i = self.slots[at[open_]]
            hit = (i >= 0) & (self.keys[i] == key[open_])
            found[open_[hit]] = i[hit]
            open_ = open_[~hit & (i >= 0)]
            at[open_] = (at[open_] + 1) & (len(self.slots) - 1)
        return found

    def merges(self) -> dict[int, tuple[int, int]]:
        """Rank and new id of each pair (left << 20 | right), for point updates; made when first asked for."""
        if not self._merges:
            self._merges = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made.tolist(), strict=True), strict=True))
        return self._merges

    def cut(self, text: str) -> list[str]:
        """The words of a text without special tokens, normalised."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # case is mapped by character, without context
        text = text.lower()
        if self.narrow is not None:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return self.words.findall(text)
            return self.narrow.findall(text)
        return self.words.findall(text)

    def pieces(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text cut at special tokens, and whether a piece is one."""
        at = 0
        for m in self.specials.finditer(text) if any(c in text for c in self.starts) else ():
            yield text[at : m.start()], False
            yield m[0], True
            at = m.end()
        yield text[at:], False


#: The cutting rule that _narrow knows (fixed value, as in the vocabulary file).
RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _narrow(rule: str) -> re.Pattern | None:
    """RULE for texts of code points up to 255 in Python's faster re, with its classes written out."""
    if rule != RULE:
        return None
    low = [chr(c) for c in range(256)]
    letters, numbers, blanks = ("".join(re.escape(c) for c in low if regex.match(k, c)) for k in (r"\p{L}", r"\p{N}", r"\s"))
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{blanks}{letters}{numbers}]+")


def _slot(key: np.ndarray, size: int) -> np.ndarray:
    h = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - int(size).bit_length() + 1)).astype(np.int64)


def _table(keys: np.ndarray) -> np.ndarray:
    """An open-addressing table of indices of keys, a quarter full at most."""
    size = 1 << (4 * len(keys)).bit_length()
    slots = np.full(size, -1, np.int64)
    for i, at in enumerate(_slot(keys, size).tolist()):
        while slots[at] >= 0:
            at = (at + 1) & (size - 1)
        slots[at] = i
    return slots


class PairForest:
    """Segment trees over the adjacent pairs of many words, a row each, all of one width (a power of two)."""

    def __init__(self, vocabulary: Vocabulary, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.v, self.ids = vocabulary, ids
        rows, self.width = ids.shape
        at = np.arange(self.width)
        self.next = np.where(at + 1 < lengths[:, None], at + 1, -1)
        self.prev = np.where(at < lengths[:, None], at - 1, -1)
        self.tree = np.full((rows, 2 * self.width), NONE, np.int64)
        r, c = np.nonzero(self.next >= 0)
        self.tree[r, self.width + c] = self._keys(r, c)
        level = self.width
        while level > 1:
            half = self.tree[:, level : 2 * level]
            level //= 2
            self.tree[:, level : 2 * level] = np.minimum(half[:, ::2], half[:, 1::2])

    def _keys(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Rank and place of the pair that begins at c in row r."""
        n = self.next[r, c]
        found = np.where(n >= 0, self.v.pair(self.ids[r, c], self.ids[r, n]), -1)
        return np.where(found >= 0, self.v.ranks[found] * self.width + c, NONE)

    def _update(self, r: np.ndarray, c: np.ndarray, key: np.ndarray) -> None:
        """Set leaves and mend the nodes above them."""
        node = c + self.width
        self.tree[r, node] = key
        while self.width > 1 and node[0] > 1:
            node = node >> 1
            self.tree[r, node] = np.minimum(self.tree[r, 2 * node], self.tree[r, 2 * node + 1])

    def merge(self) -> None:
        """Merge in every row until its root holds no pair."""
        r = np.flatnonzero(self.tree[:, 1] < NONE)
        while len(r):
            c = self.tree[r, 1] % self.width
            n = self.next[r, c]
            self.ids[r, c] = self.v.made[self.v.pair(self.ids[r, c], self.ids[r, n])]
            after = self.next[r, n]
            self.next[r, c] = after
            self.next[r, n] = -1
            on = after >= 0
            self.prev[r[on], after[on]] = c[on]
            self.ids[r, n] = -1
            self._update(r, n, np.full(len(r), NONE))
            self._update(r, c, self._keys(r, c))
            before = self.prev[r, c]
            on = before >= 0
            if on.any():
                self._update(r[on], before[on], self._keys(r[on], before[on]))
            r = r[self.tree[r, 1] < NONE]


def merge_one(v: Vocabulary, ids: np.ndarray) -> list[int]:
    """The ids of one word after all merges, by a segment tree in lists."""
    n, made, ranks = len(ids), ids.tolist(), v.merges()
    width = max(2, 1 << (n - 1).bit_length())
    found = v.pair(ids[:-1], ids[1:])
    level = np.full(width, NONE, np.int64)
    level[: n - 1] = np.where(found >= 0, v.ranks[found] * width + np.arange(n - 1), NONE)
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
    none = int(NONE)
    tree = [none, *np.concatenate(levels[::-1]).tolist()]
    after, before = [*range(1, n), -1], list(range(-1, n - 1))

    def update(at: int, key: int) -> None:
        node = at + width
        tree[node] = key
        while node > 1:
            other = tree[node ^ 1]
            node >>= 1
            least = key if key < other else other
            if tree[node] == least:
                return
            tree[node] = key = least

    while tree[1] < none:
        at = tree[1] % width
        taken = after[at]
        made[at], made[taken] = ranks[made[at] << 20 | made[taken]][1], -1
        after[at] = after[taken]
        if after[at] >= 0:
            before[after[at]] = at
        update(taken, none)
        for left in (at, before[at]):
            if left >= 0:
                pair = ranks.get(made[left] << 20 | made[after[left]]) if after[left] >= 0 else None
                update(left, pair[0] * width + left if pair else none)
    return [i for i in made if i >= 0]


#: Words of like length that make an array call worth its price.
FEW = 24


def encode_words(v: Vocabulary, words: list[str], cells: int = 1 << 18) -> list[np.ndarray]:
    """The ids of each word (not empty)."""
    raw = [w.encode() for w in words]
    out: list = [None] * len(words)
    by_width: dict[int, list[int]] = {}
    for i, b in enumerate(raw):
        by_width.setdefault(max(2, 1 << (len(b) - 1).bit_length()), []).append(i)
    for width, members in by_width.items():
        step = max(1, cells // width)
        if min(len(members), step) <= FEW:
            for i in members:
                bytes_ = np.frombuffer(raw[i], np.uint8)
                out[i] = np.array(merge_one(v, np.append(v.first[bytes_[:-1]], v.last[bytes_[-1]])), "<u4")
            continue
        for at in range(0, len(members), step):
            some = members[at : at + step]
            lengths = np.array([len(raw[i]) for i in some])
            flat = np.frombuffer(b"".join(raw[i] for i in some), np.uint8)
            rows = np.repeat(np.arange(len(some)), lengths)
            ends = np.cumsum(lengths)
            columns = np.arange(len(flat)) - np.repeat(ends - lengths, lengths)
            ids = np.full((len(some), width), -1, np.int64)
            ids[rows, columns] = v.first[flat]
            ids[np.arange(len(some)), lengths - 1] = v.last[flat[ends - 1]]
            forest = PairForest(v, ids, lengths)
            forest.merge()
            kept = forest.ids >= 0
            flat_ids = forest.ids[kept].astype("<u4")
            for i, part in zip(some, np.split(flat_ids, np.cumsum(kept.sum(1))[:-1]), strict=True):
                out[i] = part
    return out


class Encoder:
    """Encodes texts, with a table of ``max_words`` words: beyond that, the older half goes before a new batch."""

    MOST_CHARS = 64

    def __init__(self, vocabulary: Vocabulary, max_words: int = 100_000) -> None:
        self.v, self.max_words = vocabulary, max_words
        self.ids: dict[str, bytes] = {}
        self.decoded: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        for w, ids in zip(words, encode_words(self.v, words), strict=True):
            self.ids[w] = ids.tobytes()
            self.decoded[w] = b" ".join(map(self.v.tokens.__getitem__, ids.tolist()))

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """For each text its ids (little-endian unsigned 32-bit) and those ids decoded (UTF-8)."""
        if len(self.ids) > self.max_words:
            for w in list(self.ids)[: len(self.ids) // 2]:
                del self.ids[w], self.decoded[w]
        cut = [[(p, True) if special else (self.v.cut(p), False) for p, special in self.v.pieces(t)] for t in texts]
        missing: set[str] = set()
        for pieces in cut:
            for words, special in pieces:
                if not special:
                    missing.update(set(words).difference(self.ids))
        if missing:
            self._learn(list(missing))
        of_ids, of_decoded = self.ids.__getitem__, self.decoded.__getitem__
        out = []
        for pieces in cut:
            ids, decoded = [], []
            for words, special in pieces:
                if special:
                    ids.append(self.v.special[words].to_bytes(4, "little"))
                    decoded.append(words.encode())
                elif words:
                    ids.extend(map(of_ids, words))
                    decoded.extend(map(of_decoded, words))
            out.append((b"".join(ids), b" ".join(decoded)))
        for w in missing:
            if len(w) > self.MOST_CHARS:
                del self.ids[w], self.decoded[w]
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids: their tokens with blanks between, as the vocabulary file names no decoder."""
        return b" ".join(self.v.tokens[i] for i in np.frombuffer(ids, "<u4").tolist()).decode()


def encode_documents(df: DataFrame, vocabulary_text: str, with_ids: bool = False, max_words: int = 100_000) -> DataFrame:
    """All columns of ``df`` with n_tokens and the digests of ids and decoded text, and ids if asked for.

    ``vocabulary_text``: the content of the vocabulary file (a few MB), read once by the driver and sent to executors.
    """
    spark: SparkSession = df.sparkSession
    added = [StructField(ADDED[0], LongType()), *(StructField(a, StringType()) for a in ADDED[1:]), *([StructField("ids", BinaryType())] if with_ids else [])]
    df = df.drop(*(f.name for f in added))
    sent = spark.sparkContext.broadcast(vocabulary_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent, max_words)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                found = encoder.encode([t or "" for t in b["text"].to_pylist()])
                columns = [
                    *b.columns,
                    pa.array([len(i) // 4 for i, _ in found], pa.int64()),
                    pa.array([hashlib.sha256(i).hexdigest() for i, _ in found], pa.string()),
                    pa.array([hashlib.sha256(d).hexdigest() for _, d in found], pa.string()),
                ]
                names = [*b.schema.names, *ADDED]
                if with_ids:
                    columns.append(pa.array([i for i, _ in found], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return in_batches(df, run, StructType([*df.schema.fields, *added]))


_ENCODERS: dict[int, Encoder] = {}


def _encoder(sent, max_words: int) -> Encoder:
    """The worker's encoder of a broadcast vocabulary: tasks of one worker share its table of words."""
    key = hash(sent.value)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(Vocabulary(sent.value), max_words)
    return _ENCODERS[key]
