"""Quality classifier by compression.

Two zstandard dictionaries are built from labelled text, one from good and one from bad. A text is compressed with
each, block by block over its whole length; the difference of the two sizes, divided by the text's bytes (and a few
more), becomes a probability by logistic calibration on labelled texts that the dictionaries have not seen.

Fitting reads a bounded sample of labelled rows (``max_rows`` a class, those with the smallest hash of their id);
scoring reads every whole text. Only the text enters a score. A dictionary holds ``dictionary_bytes``, shared out evenly:
of each text in it the middle piece, as ends are often alike, so that as many texts as fit have a say. Executors cut the
pieces and measure the texts for the calibration; the driver sees pieces (two dictionaries) and three numbers a text.

Null or empty text: the share of label 1 among labelled rows. Equal texts, equal scores. Without labels of both classes
every score is that share, lightly smoothed. Empty tables give no rows. Extra columns stay as they are,
but for ``score`` and ``predicted``, which are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewright.llm.common import bound_batches, discard, in_batches, materialize, without_keys

LEVEL, BLOCK, FEW = 6, 2048, 100


@dataclass(frozen=True)
class CompressionModel:
    """Dictionaries and calibration: the log odds are slope * difference + weight * share + prior, where share is
    bytes / (bytes + FEW), so a short text stays near the prior odds."""

    good: bytes
    bad: bytes
    slope: float
    weight: float
    prior: float

    def scorer(self):
        """A function from texts to scores; each process makes its own compressors."""
        measure = _measure(self.good, self.bad)

        def score(texts: list[str | None]) -> np.ndarray:
            x = np.array([measure(t or "") for t in texts], float).reshape(-1, 2)
            return 1 / (1 + np.exp(-np.clip(x @ (self.slope, self.weight) + self.prior, -30, 30)))

        return score


def _measure(good: bytes, bad: bytes):
    """A function from a text to (size with the bad dictionary - size with the good one) / (bytes + FEW), and share."""
    if not good or not bad:
        return lambda text: (0.0, 0.0)
    ways = []
    for raw in (bad, good):
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        ways.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress)
    from_bad, from_good = ways

    def measure(text: str) -> tuple[float, float]:
        data = text.encode()
        difference = 0
        for at in range(0, len(data), BLOCK):
            block = data[at : at + BLOCK]
            difference += len(from_bad(block)) - len(from_good(block))
        return difference / (len(data) + FEW), len(data) / (len(data) + FEW)

    return measure


def _calibrate(x: np.ndarray, y: np.ndarray, weights: np.ndarray, prior: float) -> np.ndarray:
    """Logistic regression without intercept, as the prior is given: Newton's method with a little shrinkage."""
    scale = x.std(0) + 1e-9
    z, w = x / scale, np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w + prior, -30, 30)))
        g = z.T @ (weights * (p - y)) + 0.01 * w
        h = (z * (weights * p * (1 - p))[:, None]).T @ z + 0.01 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step
        if abs(step).max() < 1e-9:
            break
    return w / scale


def fit(documents: DataFrame, labels: DataFrame, max_rows: int = 2000, dictionary_bytes: int = 1 << 20) -> CompressionModel:
    """Fit on documents (doc_id, text) and labels (doc_id, label, 1: good).

    Of each class the ``max_rows`` ids with the smallest hash are taken, so what is broadcast to find their texts is
    bounded, and of other texts none is shuffled. Two thirds make the dictionaries, a third calibrates.
    The prior odds are those of all labels, lightly smoothed.
    """
    known = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("label").cast("int").alias("label"))
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    prior = math.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1))
    rank = F.xxhash64(F.lit(5), "doc_id")
    good, bad = (known.where(F.col("label") == k).distinct().orderBy(rank, "doc_id").limit(max_rows) for k in (1, 0))
    found = documents.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(good.union(bad)), "doc_id")
    first = found.withColumn("rank", rank).orderBy("rank", "doc_id", "text").limit(2 * max_rows)
    sample = materialize(first.withColumn("i", F.row_number().over(Window.partitionBy("label").orderBy("rank", "doc_id", "text")) - 1), "sample")
    model = _fit_sample(sample, prior, dictionary_bytes)
    discard(sample)
    return model


def _fit_sample(sample: DataFrame, prior: float, dictionary_bytes: int) -> CompressionModel:
    """The model of a sample (label, i: the row's number in its class, text), two thirds for dictionaries."""
    n = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(n) < 2:
        return CompressionModel(b"", b"", 0.0, 0.0, prior)
    builds = (F.col("i") % 3 != 0) | (F.when(F.col("label") == 1, n[1]).otherwise(n[0]) == 1)
    lines = sample.select("label", "i", builds.alias("builds"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    common = lines.groupBy("line").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select(F.xxhash64("line").alias("hash"))
    own = without_keys(lines.where("builds").withColumn("hash", F.xxhash64("line")), common, "hash").groupBy("label", "i").agg(F.sort_array(F.collect_list(F.struct("at", "line"))).alias("lines"))
    data = F.array_join(F.transform("lines", lambda x: x["line"]), "\n").cast("binary")
    share = {k: max(256, dictionary_bytes // max(1, n[k] - (n[k] + 2) // 3)) for k in n}
    piece = F.when(F.col("label") == 1, share[1]).otherwise(share[0])
    cut = F.substring("data", F.greatest(F.lit(0), F.floor((F.octet_length("data") - piece) / 2)).cast("int") + 1, piece)
    rows = own.select("label", "i", data.alias("data")).select("label", "i", cut.alias("piece")).orderBy("label", "i").collect()
    built = [b"\n".join(bytes(r.piece) for r in rows if r.label == k)[-dictionary_bytes:] for k in (1, 0)]

    sent = sample.sparkSession.sparkContext.broadcast(tuple(built))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = _measure(*sent.value)
        for b in batches:
            x = [measure(t) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["label"], b["i"], pa.array([d for d, _ in x], pa.float64()), pa.array([s for _, s in x], pa.float64())], names=["label", "i", "difference", "share"])

    held = in_batches(sample.where("i % 3 = 0").select("label", "i", "text"), run, "label int, i int, difference double, share double").orderBy(F.desc("label"), "i").collect()
    x, y = np.array([(r.difference, r.share) for r in held]), np.array([float(r.label) for r in held])
    odds = 1 / (1 + math.exp(-prior))
    weights = np.where(y == 1, odds / max(1, (y == 1).sum()), (1 - odds) / max(1, (y == 0).sum())) * len(y)
    slope, weight = _calibrate(x, y, weights, prior).tolist()
    return CompressionModel(*built, slope, weight, prior)


def score(df: DataFrame, model: CompressionModel, text: str = "text") -> Column:
    """A column of scores of ``text``: the model goes to the executors once, as a broadcast of two dictionaries."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    bound_batches(df.sparkSession)

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = sent.value.scorer()
        for texts in batches:
            yield pa.array(scorer(texts.to_pylist()), pa.float64())

    return run(F.col(text))


def with_quality(df: DataFrame, model: CompressionModel, threshold: float = 0.7) -> DataFrame:
    """Add score and predicted (1 if the score is at least ``threshold``)."""
    df = df.drop("score", "predicted")
    return df.withColumn("score", score(df, model)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
