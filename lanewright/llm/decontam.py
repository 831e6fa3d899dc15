"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A text overlaps an item where, of ``window`` aligned words in a row (the whole item if it is shorter), at least
``percent`` per cent are equal. A seed is a hash of the words that a fixed mask keeps; the words that it ignores may have
been substituted. Seeds of every text meet the seeds of the benchmark items in a join; a hit fixes how text and item are
aligned, and the aligned words around it are compared one by one.

At the default window and percentage no overlap is lost (a test tries all cases). Items of 13 words or more have seeds
at every place and texts at every third, with two masks: any 2 substituted words of 13 leave a seed whole, wherever the
passage stands. Shorter items must be there whole, so they are cut into blocks of three words (:func:`short_seeds`),
and these meet the three words at every place of a text: 10 to 12 words may lack two and have three blocks at least, 6
to 9 may lack one and have two; 5 words may lack one and have two blocks and a mask around the middle; 4 words or fewer
must be equal and have one seed. Masks that no item asks for are not taken.

The first pass moves seeds and places only, never words: a row a hit, (key of the row, item, shift). The second reads
the texts that were hit, splits each once and takes the words that lie beside the item. Hits are broadcast if there are
few, by count; else both sides are shuffled. So work and memory grow with the texts' length, not its square.

Words: runs of letters and digits, in lower case. Null or empty texts and items have no words and overlap nothing.
Repeated rows give one result. Texts that share an id are compared one by one, their windows are added up under the
id; rows with a null id count as one document without id. An item is an id with its words: texts that share an id, or
have none, are compared one by one and reported under it. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewright.llm.common import free_name, materialize, tasks_for, without_keys

#: Places that each mask keeps (fixed values): of items as long as the window, then of shorter ones.
MASKS = ((0, 1, 2, 4), (0, 2, 3, 7))
BLOCK, AROUND, PAIR, ONE = (0, 1, 2), (0, 1, 3, 4), (0, 1), (0,)
STRIDE, LONG = 3, 13


def short_seeds(n: int) -> list[tuple[tuple[int, ...], int]]:
    """The masks and places of an item of ``n`` words, fewer than LONG."""
    if n >= 6:
        return [(BLOCK, at) for at in range(0, n - 2, 3)]
    return {5: [(BLOCK, 0), (BLOCK, 2), (AROUND, 0)], 4: [(BLOCK, 0)], 3: [(BLOCK, 0)], 2: [(PAIR, 0)], 1: [(ONE, 0)]}[n]


def words_of(text: str = "text") -> Column:
    """The words of a text as an array."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _seed(mask: tuple[int, ...], place: Column) -> Column:
    hashed = F.xxhash64(F.lit(str(mask)), *(F.get("words", place + at) for at in mask))
    return F.struct(hashed.alias("seed"), place.cast("int").alias("at"))


def _seeds(mask: tuple[int, ...], stride: int) -> Column:
    """The seeds of a mask at places 0, stride, ... of ``words``."""
    last = F.size("words") - (mask[-1] + 1)
    places = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: _seed(mask, i))


def _item_seeds(lengths: list[int]) -> Column:
    """The seeds of an item, whose words are at most so many; LONG stands for all from LONG on."""
    out = F.concat(*(_seeds(m, 1) for m in MASKS))
    for n in lengths:
        if n < LONG:
            out = F.when(F.size("words") == n, F.array(*(_seed(m, F.lit(at)) for m, at in short_seeds(n)))).otherwise(out)
    return out


def _text_seeds(lengths: list[int]) -> Column:
    """The seeds of a text that items of these lengths ask for."""
    asked = {m for n in lengths if n < LONG for m, _ in short_seeds(n)}
    return F.concat(*(_seeds(m, STRIDE) for m in MASKS if LONG in lengths), *(_seeds(m, 1) for m in sorted(asked)))


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = 13, percent: int = 80, most_broadcast: int = 1_000_000) -> DataFrame:
    """doc_id, item_id, item_words, matched (equal words of the best alignment) and windows that overlap.

    Seeds of the benchmark and hits are broadcast if there are ``most_broadcast`` rows at most (about 50 MB).
    """
    items = benchmark.select("item_id", words_of().alias("words")).where(F.size("words") > 0).distinct()
    items = items.withColumn("item", F.xxhash64("item_id", "words")).withColumn("item_n", F.size("words"))
    lengths = sorted(r[0] for r in items.select(F.least("item_n", F.lit(LONG))).distinct().collect()) or [LONG]
    item_seeds = items.select("item", "item_n", F.inline(_item_seeds(lengths))).select("seed", "item", "item_n", F.col("at").alias("item_at")).distinct()
    if item_seeds.count() <= most_broadcast:
        item_seeds = F.broadcast(item_seeds)

    texts = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    seeded = texts.select("key", words_of().alias("words")).select("key", F.inline(_text_seeds(lengths)))
    hits = seeded.join(item_seeds, "seed").select("key", "item", "item_n", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    hits = materialize(hits, "hits", tasks_for(docs, 0.2))
    of_text = hits.groupBy("key").agg(F.collect_list(F.struct("item", "item_n", "shift")).alias("hits"))
    if hits.count() <= most_broadcast:
        of_text = F.broadcast(of_text)

    both = texts.join(of_text, "key").select("doc_id", "key", "hits", words_of().alias("words"))

    def beside(hit: Column) -> Column:
        start = F.greatest(F.lit(0), -hit["shift"])
        length = F.greatest(F.lit(0), F.least(hit["item_n"], F.size("words") - hit["shift"]) - start)
        return F.struct(hit["item"].alias("item"), hit["shift"].alias("shift"), start.alias("start"), F.slice("words", start + hit["shift"] + 1, length).alias("said"))

    aligned = both.select("doc_id", "key", F.inline(F.transform("hits", beside)))
    judged = aligned.join(items.select("item", "item_id", F.col("words").alias("asked")), "item")
    equal = F.zip_with(F.slice("asked", F.col("start") + 1, F.size("said")), "said", lambda a, b: (a == b).cast("int"))
    width = F.least(F.lit(window), F.size("asked"))
    judged = judged.withColumn("equal", equal).withColumn("width", width).where(F.size("equal") >= F.col("width"))
    total = lambda of: F.aggregate(of, F.lit(0), lambda s, x: s + x)
    good = F.filter(
        F.sequence(F.lit(1), F.size("equal") - F.col("width") + 1),
        lambda i: total(F.slice("equal", i, F.col("width"))) * 100 >= F.col("width") * percent,
    )
    found = judged.select("doc_id", "key", "item", "item_id", "shift", F.size("asked").alias("item_words"), total(F.col("equal")).alias("matched"), F.size(good).alias("windows"))
    return (
        found.where("windows > 0").distinct().groupBy("doc_id", "item_id")
        .agg(F.max("item_words").cast("long").alias("item_words"), F.max("matched").cast("long").alias("matched"), F.sum("windows").cast("long").alias("windows"))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents that overlap no item, as they are; ``doc_id`` and the text say which row is which."""
    key = free_name(docs.columns, "_key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    bad = overlaps(keyed.select(F.col(key).alias("doc_id"), "text"), benchmark, **how).select(F.col("doc_id").alias(key)).distinct()
    return without_keys(keyed, bad, key).drop(key)
