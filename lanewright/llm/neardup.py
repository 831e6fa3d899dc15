"""Near-duplicate documents by MinHash, odd sketches and exact confirmation.

1. A map over the documents makes each text's set of word shingles (as 64-bit hashes), a MinHash signature, band hashes
   of its first rows, and an odd sketch: every sample of the signature flips one bit of a bitmap, so the XOR of two
   bitmaps holds the parity of their differing samples and its population count tells a high similarity precisely.
2. Documents with the same words in the same order form one class; classes meet in buckets of equal bands.
3. In each bucket the least class (found by partial minima, so no bucket is gathered) is paired with the others, a row
   a member, never all pairs. Odd sketches drop pairs that are far from similar, the full sets confirm the rest, and
   the links give first components.
4. Only buckets that still hold several components are looked at again. Their members are dealt to blocks of bounded
   size: a component that fills blocks gets its own, the others share pooled ones, and only blocks that can hold two
   components meet. So a large group of copies beside a few strangers costs as many block pairs as it has blocks.
   Within a pair of blocks sketches are compared as arrays; only members whose sketch is near one of another component
   get their full sets, which confirm. No candidate is dropped and no list of all pairs is ever made. These links join
   first components.

Joins by bucket, class and component are sort-merge joins without an aggregation behind them in the same stage, so the
adaptive planner splits a side that one key fills.

Bands are chosen so that a pair at the threshold misses every bucket with a probability under one in 100,000; the
sketch's cut lies five standard deviations below the threshold. Shingles and components are told apart by 64-bit hashes:
among 30 GB of documents (some 15 million, 300 shingles each) the chance that any pair at the threshold is judged wrongly by a
collision in its two sets is under 1 in 10,000 in all, and that any two components of one bucket look alike under 1 in 100,000.

Words: maximal runs without ASCII white space, A-Z lower-cased. Null or empty texts have no words, are linked with
nothing and are their own component. Repeated rows and equal texts are one class; of a class's documents the least
id counts. A null id is kept only if no document of its component has an id. An empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewright.llm.common import KeyBitmap, discard, in_batches, materialize, tasks_for
from lanewright.llm.components import components

U64 = np.uint64


@dataclass(frozen=True)
class NearDup:
    """Parameters: words a shingle, the least similarity in per cent, MinHash samples, sketch bits, block limits."""

    words: int = 5
    percent: int = 80
    samples: int = 256
    bits: int = 1024
    block_rows: int = 512
    block_bytes: int = 4 << 20

    @property
    def rows(self) -> int:
        return 5 if self.percent >= 85 else 4 if self.percent >= 75 else 3

    @property
    def bands(self) -> int:
        return min(self.samples // self.rows, math.ceil(math.log(1e-5) / math.log(1 - (self.percent / 100) ** self.rows)))

    @property
    def most_bits(self) -> int:
        """The largest XOR count of a pair that sketches let through."""
        s = self.percent / 100
        s -= 5 * math.sqrt(s * (1 - s) / self.samples)
        differing = 2 * self.samples * (1 - s)
        mean = self.bits / 2 * (1 - (1 - 2 / self.bits) ** differing)
        return math.ceil(mean + 3 * math.sqrt(mean))


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


class Shingler:
    """Texts to sorted distinct shingle hashes; keeps the hashes of up to 100,000 words of 64 bytes at most (15 MB)."""

    MOST_WORDS, MOST_BYTES = 100_000, 64

    def __init__(self, words: int) -> None:
        self.words, self.known = words, {}
        self.salt = _mix(np.arange(1, words + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)

    def split(self, text: str | None) -> list[bytes]:
        """bytes.lower and bytes.split know ASCII only: exactly the words that are asked for."""
        return (text or "").encode().lower().split()

    def hashes(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.empty(0, U64)
        known, fresh = self.known, {w: xxhash.xxh3_64_intdigest(w) for w in set(words).difference(self.known)}
        if fresh:
            h = np.fromiter((fresh[w] if w in fresh else known[w] for w in words), U64, len(words))
            if len(known) + len(fresh) > self.MOST_WORDS:
                known.clear()
            known.update(x for x in fresh.items() if len(x[0]) <= self.MOST_BYTES and len(fresh) <= self.MOST_WORDS)
        else:
            h = np.fromiter(map(known.__getitem__, words), U64, len(words))
        k = min(self.words, len(h))
        n = len(h) - k + 1
        out = np.full(n, k, U64)
        for i in range(k):
            out = _mix(out ^ (h[i : i + n] * self.salt[i]))
        return np.unique(out)


class Signer:
    """Signatures, bands and odd sketches of shingle sets."""

    def __init__(self, p: NearDup) -> None:
        self.p = p
        rng = np.random.default_rng(20240229)
        self.a = (rng.integers(0, 1 << 32, p.samples, dtype=np.uint32) | np.uint32(1))
        self.b = rng.integers(0, 1 << 32, p.samples, dtype=np.uint32)
        self.place = _mix(np.arange(1, p.samples + 1, dtype=U64) * U64(0xBF58476D1CE4E5B9))

    def sign(self, shingles: np.ndarray) -> np.ndarray:
        low = (shingles >> U64(32)).astype(np.uint32)
        least = np.full(self.p.samples, 0xFFFFFFFF, np.uint32)
        for at in range(0, len(low), 1024):
            np.minimum(least, (low[at : at + 1024, None] * self.a + self.b).min(axis=0), out=least)
        return least

    def bands(self, signatures: np.ndarray) -> np.ndarray:
        """Band hashes, a row a signature."""
        p = self.p
        rows = signatures[:, : p.bands * p.rows].reshape(-1, p.bands, p.rows).astype(U64)
        out = np.tile(_mix(np.arange(p.bands, dtype=U64) + U64(77)), (len(rows), 1))
        for i in range(p.rows):
            out = _mix(out ^ rows[:, :, i] * U64(0x9E3779B97F4A7C15))
        return out

    def sketches(self, signatures: np.ndarray) -> np.ndarray:
        """Odd sketches as rows of 64-bit words."""
        p = self.p
        bit = (_mix(signatures.astype(U64) ^ self.place) % U64(p.bits)).astype(np.int64)
        flat = (np.arange(len(bit))[:, None] * p.bits + bit).ravel()
        odd = (np.bincount(flat, minlength=len(bit) * p.bits) & 1).astype(np.uint8)
        return np.packbits(odd.reshape(len(bit), p.bits), axis=1).view(U64)


def _key(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def _longs(rows: np.ndarray, at: list[int], n: int) -> pa.Array:
    """``n`` lists of longs, the rows of a matrix of 64-bit words at the places ``at`` and null elsewhere."""
    rows = np.ascontiguousarray(rows).view(np.int64)
    here = np.zeros(n, bool)
    here[at] = True
    offsets = np.concatenate([[0], np.cumsum(here) * rows.shape[1]]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()), mask=pa.array(~here))


def _matrix(column: pa.Array) -> np.ndarray:
    """The other way round, for lists of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).view(U64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


SLICE = 250


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            yield b.slice(at, SLICE)


class _Seen:
    """Keys that a task has met, the last 50,000 or more of them: most repeats are dropped before they are moved."""

    def __init__(self) -> None:
        self.keys: set[bytes] = set()

    def new(self, key: bytes) -> bool:
        if key in self.keys:
            return False
        if len(self.keys) >= 50_000:
            self.keys.clear()
        self.keys.add(key)
        return True


def signatures(docs: DataFrame, p: NearDup) -> DataFrame:
    """A row per document: doc_id, key (null without words), n_shingles, head (the key's first 64 bits), bands, sketch.

    Bands and sketch are null where the same task has given them for that key before.
    """
    docs = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signer, seen, sizes = Shingler(p.words), Signer(p), _Seen(), {}
        for b in _slices(batches):
            keys, counts, signed, at = [], [], [], []
            for i, text in enumerate(b["text"].to_pylist()):
                words = shingler.split(text)
                key = _key(words) if words else None
                keys.append(key)
                if key is None or key not in seen.keys or key not in sizes:
                    shingles = shingler.hashes(words)
                    counts.append(len(shingles))
                    if key is not None:
                        if seen.new(key):
                            at.append(i)
                            signed.append(signer.sign(shingles))
                        sizes = sizes if len(sizes) < 50_000 else {}
                        sizes[key] = len(shingles)
                else:
                    counts.append(sizes[key])
            matrix = np.array(signed, np.uint32).reshape(len(signed), p.samples)
            heads = [None if k is None else int.from_bytes(k[:8], "little", signed=True) for k in keys]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(heads, pa.int64()),
                 _longs(signer.bands(matrix), at, b.num_rows), _longs(signer.sketches(matrix), at, b.num_rows)],
                names=["doc_id", "key", "n_shingles", "head", "bands", "sketch"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return in_batches(docs, run, f"doc_id {id_type}, key binary, n_shingles long, head long, bands array<long>, sketch array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, p: NearDup) -> DataFrame:
    """key, shingles of the classes in ``wanted`` (head), from the whole texts; a fixed bitmap of the wanted heads goes
    to the tasks, so that other texts are not cut into shingles and not moved."""
    sent = docs.sparkSession.sparkContext.broadcast(KeyBitmap.of(wanted, "head"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(p.words), _Seen()
        for b in _slices(batches):
            split = [shingler.split(t) for t in b["text"].to_pylist()]
            found = [_key(words) if words else bytes(16) for words in split]
            here = sent.value.has(np.frombuffer(b"".join(k[:8] for k in found), np.int64)).tolist()
            rows = [(k, shingler.hashes(words).view(np.int64)) for k, words, on in zip(found, split, here, strict=True) if on and words and seen.new(k)]
            offsets = np.cumsum([0, *(len(s) for _, s in rows)]).astype(np.int32)
            flat = np.concatenate([s for _, s in rows]) if rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["key", "shingles"])

    found = in_batches(docs.select("text"), cut, "key binary, shingles array<long>")
    return materialize(found.repartition("key").dropDuplicates(["key"]), "sets", tasks_for(docs, 2))


def _similar(p: NearDup):
    """Whether 100 * intersection >= percent * union, of the full sets."""
    both = F.size(F.array_intersect("shingles", "other")).cast("long")
    return both * 100 >= (F.size("shingles") + F.size("other") - both) * p.percent


def _differing(x: str, y: str):
    """Population count of the XOR of two sketches."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, c: s + c)


def _first_links(docs: DataFrame, classes: DataFrame, members: DataFrame, p: NearDup) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of each bucket's least class with the others, and the shingle sets of all that share a bucket."""
    sketch = classes.select("key", "sketch")
    leader = classes.select(F.col("head").alias("lo"), F.col("key").alias("leader"), F.col("sketch").alias("other"))
    pairs = members.where("head <> lo").select("key", "lo").repartition("key").distinct()
    near = pairs.join(sketch, "key").join(leader, "lo").where((F.col("key") != F.col("leader")) & (_differing("sketch", "other") <= p.most_bits))
    sets = shingle_sets(docs, members.select("head"), p)
    found = (
        near.select("leader", "key").join(sets, "key")
        .join(sets.select(F.col("key").alias("leader"), F.col("shingles").alias("other")), "leader")
        .where(_similar(p))
        .select(F.col("leader").alias("a"), F.col("key").alias("b"))
    )
    return found, sets


def joined_classes(docs: DataFrame, signed: DataFrame, p: NearDup) -> DataFrame:
    """key, component of the classes that similar pairs join with others."""
    classes = signed.where("bands IS NOT NULL").select("key", "n_shingles", "head", "bands", "sketch").dropDuplicates(["key"])
    classes = materialize(classes, "classes", tasks_for(signed))
    dealt = classes.select("key", "head", F.explode("bands").alias("bucket"))
    shared = dealt.groupBy("bucket").agg(F.min("head").alias("lo"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialize(dealt.join(shared.select("bucket", "lo"), "bucket"), "members", tasks_for(classes, 3))
    links, sets = _first_links(docs, classes, members, p)
    first = components(links, tasks_for(classes, 0.2)).withColumnRenamed("node", "key")
    again, used = _second_look(members, classes, sets, first, p)
    top = components(again, tasks_for(classes, 0.1)).withColumnRenamed("component", "top") if again is not None else None
    discard(members, classes, sets, *used)
    if top is None:
        return first
    ends = first.unionByName(top.select(F.col("node").alias("key"), F.col("node").alias("component")).join(first, "key", "left_anti"))
    return ends.join(top, F.col("component") == F.col("node"), "left").select("key", F.coalesce("top", "component").alias("component"))


def _second_look(members: DataFrame, classes: DataFrame, sets: DataFrame, first: DataFrame, p: NearDup) -> tuple[DataFrame | None, list[DataFrame]]:
    """Links (a, b) between the components of buckets that hold several (None if there is no such bucket), and the written
    tables that they are read from."""
    known = members.select("bucket", "key").join(first, "key", "left").select("bucket", "key", F.coalesce("component", "key").alias("component"))
    known = materialize(known.withColumn("c", F.xxhash64("component")), "known", tasks_for(members))
    mixed = known.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("bucket")
    rows = known.join(mixed, "bucket", "left_semi").join(classes.select("key", "n_shingles"), "key")
    rows = materialize(rows, "mixed", tasks_for(members))
    discard(known)
    if rows.isEmpty():
        return None, [rows]

    bytes_ = F.sum("n_shingles") * 8
    blocks = lambda n, size: F.greatest(F.ceil(n / p.block_rows), F.ceil(size / p.block_bytes)).cast("int")
    parts = rows.groupBy("bucket", "c").agg(F.count(F.lit(1)).alias("n"), bytes_.alias("size")).withColumn("parts", blocks(F.col("n"), F.col("size")))
    small = F.col("parts") == 1
    pools = parts.where(small).groupBy("bucket").agg(blocks(F.sum("n"), F.sum("size")).alias("pools"))
    parts = materialize(parts.join(pools, "bucket", "left").select("bucket", "c", "parts", F.coalesce("pools", F.lit(0)).alias("pools")), "parts", tasks_for(rows))
    name = lambda c, i: F.xxhash64(F.col("bucket"), c, i)
    own = parts.where(~small).select("bucket", "c", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"))
    pooled = parts.where(small).select("bucket", F.lit(None).cast("long").alias("c"), F.pmod("c", "pools").cast("int").alias("i")).distinct()
    named = materialize(own.unionByName(pooled).select("bucket", "c", name(F.col("c"), F.col("i")).alias("block")), "blocks", tasks_for(rows, 0.2))
    x, y = named.select("bucket", "c", "block"), named.select("bucket", F.col("c").alias("d"), F.col("block").alias("with"))
    meet = x.join(y, "bucket").where("block <= with AND NOT coalesce(c = d, false)").select("block", "with")
    task = F.xxhash64("block", "with").alias("task")
    ways = meet.select("block", task).union(meet.where("block <> with").select("with", task))
    place = F.when(small, name(F.lit(None).cast("long"), F.pmod("c", "pools").cast("int"))).otherwise(name(F.col("c"), F.pmod(F.xxhash64("key"), "parts").cast("int")))
    placed = rows.join(parts, ["bucket", "c"]).select("bucket", "key", "component", place.alias("block"))
    dealt = placed.join(ways, "block").join(classes.select("key", "bands", "sketch"), "key")
    columns = ["task", "bucket", "block", "key", "component", "bands", "sketch"]
    likely = in_batches(_by_task(dealt.select(*columns)), _each_task(lambda t: _likely_rows(t, p.most_bits)), dealt.select(*columns).schema)
    likely = materialize(likely, "likely", tasks_for(rows, 8))
    if likely.isEmpty():
        return None, [rows, parts, named, likely]
    whole = _by_task(likely.join(sets, "key").select(*columns, "shingles"))
    return in_batches(whole, _each_task(lambda t: _links_within(t, p.most_bits, p.percent)), "a binary, b binary"), [rows, parts, named, likely]


def _by_task(dealt: DataFrame) -> DataFrame:
    return dealt.repartition("task").sortWithinPartitions("task")


def _each_task(work):
    """A map that gives ``work`` the rows of one task (one block, or two) at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for b in batches:
            ids = b["task"].to_numpy()
            edges = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1), len(ids)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if hi > lo:
                    if kept and ids[lo] != kept[0]["task"][0].as_py():
                        yield from work(pa.Table.from_batches(kept).combine_chunks()).to_batches()
                        kept = []
                    kept.append(b.slice(lo, hi - lo))
        if kept:
            yield from work(pa.Table.from_batches(kept).combine_chunks()).to_batches()

    return run


class _Members:
    """The rows of one task as arrays."""

    def __init__(self, t: pa.Table, most: int) -> None:
        self.most, bucket = most, np.array(t["bucket"][0].as_py(), np.int64).view(U64)
        self.names = t["component"].to_pylist()
        numbers = {c: n for n, c in enumerate(dict.fromkeys(self.names))}
        self.at = np.array([numbers[c] for c in self.names])
        self.bands, self.sketches = _matrix(t["bands"].combine_chunks()), _matrix(t["sketch"].combine_chunks())
        self.block = t["block"].to_numpy()
        self.across = bool((self.block != self.block[0]).any())
        self.band = int(np.flatnonzero((self.bands == bucket).all(0))[0])

    def near(self, x: int) -> np.ndarray:
        """The later rows of other components (and blocks, if there are two) whose sketch is near that of ``x``."""
        rest = np.arange(x + 1, len(self.at))
        ok = self.at[rest] != self.at[x]
        if self.across:
            ok &= self.block[rest] != self.block[x]
        rest = rest[ok]
        rest = rest[np.bitwise_count(self.sketches[rest] ^ self.sketches[x]).sum(1, dtype=np.int64) <= self.most]
        if self.band:  # a pair is looked at in the first bucket that it shares
            rest = rest[~(self.bands[rest, : self.band] == self.bands[x, : self.band]).any(1)]
        return rest


def _likely_rows(t: pa.Table, most: int) -> pa.Table:
    """The rows whose sketch is near one of another component."""
    m, wanted = _Members(t, most), np.zeros(t.num_rows, bool)
    for x in range(t.num_rows - 1):
        near = m.near(x)
        wanted[near] = True
        wanted[x] |= len(near) > 0
    return t.filter(pa.array(wanted))


def _links_within(t: pa.Table, most: int, percent: int) -> pa.Table:
    """Links of components within one block, or of two blocks with one another."""
    m, out = _Members(t, most), []
    sets = t["shingles"].combine_chunks()
    sets = np.split(sets.flatten().to_numpy(), sets.offsets.to_numpy()[1:-1] - sets.offsets.to_numpy()[0])
    for x in range(t.num_rows - 1):
        for y in m.near(x).tolist():
            if m.at[y] == m.at[x]:
                continue
            a, b = sets[x], sets[y]
            if min(len(a), len(b)) * 100 < max(len(a), len(b)) * percent:
                continue
            both = len(np.intersect1d(a, b, assume_unique=True))
            if both * 100 >= (len(a) + len(b) - both) * percent:
                out.append((m.names[x], m.names[y]))
                m.at[m.at == m.at[y]] = m.at[x]
    return pa.table({"a": pa.array([a for a, _ in out], pa.binary()), "b": pa.array([b for _, b in out], pa.binary())})


def near_duplicates(docs: DataFrame, p: NearDup) -> DataFrame:
    """A row per document: doc_id (of any type that has an order), n_shingles, component_id (the least id of its
    component), kept."""
    signed = materialize(signatures(docs, p), "signed")
    joined = joined_classes(docs, signed, p)
    ids = signed.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("least"))
    named = ids.join(joined, "key", "left").withColumn("component", F.coalesce("component", "key"))
    named = materialize(named, "named", tasks_for(signed, 0.5))
    # written, so that the join behind it has no aggregation in its stage and a large component's side can be split
    least = materialize(named.groupBy("component").agg(F.min("least").alias("component_id")), "least", tasks_for(signed, 0.2))
    of_key = named.select("key", "component").join(least, "component").select("key", "component_id")
    found = signed.where("key IS NOT NULL").select("key", "doc_id", "n_shingles").join(of_key, "key").select("doc_id", "n_shingles", "component_id")
    empty = signed.where("key IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.union(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
