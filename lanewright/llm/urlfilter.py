"""URL filters: host and path rules, and gradient-boosted trees on lexical features for what no rule decides.

DataFrame and SQL functions only, with the JVM's models; nothing runs in Python on the executors.

The trees are trained on labelled urls. :func:`labelled_pages` takes the labels from the tables: what a page says is
judged by a model of text quality, fitted on labelled documents, and a url is to be blocked if its page's text is bad.
Rules take no part in that, as trees would only learn them back. The trees see the url alone.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; path: what follows up to
``?``, ``#`` or the end. A null url or one without ``://`` has both empty and fits no rule; the trees judge it by its
(empty) features. Equal urls get equal verdicts; repeated rows all stay; an empty table gives no rows; without
labelled urls of both classes, what no rule decides is allowed. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewright.llm.common import discard, materialize

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789-._/?=&%:#"
FEATURES = ("length", "host_length", "depth", "labels", "hyphens", "host_digits", "digit_ratio", "entropy", "parameters", "suffix_rate")


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Add host and path."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return df.withColumn("host", lowered).withColumn("path", F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1))


def fitting_rule(rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(slash + path))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def lexical_features(df: DataFrame, url: str = "url") -> DataFrame:
    """Add the features that need no statistics; df has host and path."""
    u = F.lower(F.coalesce(url, F.lit("")))
    n = F.greatest(F.length(u), F.lit(1))
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    entropy = F.lit(0.0)
    for c in ALPHABET:
        p = (F.length(u) - F.length(F.replace(u, F.lit(c), F.lit("")))) / n
        entropy = entropy - F.when(p > 0, p * F.log2(p)).otherwise(0.0)
    count = lambda s, c: F.length(s) - F.length(F.replace(s, F.lit(c), F.lit("")))
    return df.select(
        "*",
        F.length(u).cast("double").alias("length"),
        F.length("host").cast("double").alias("host_length"),
        count(F.col("path"), "/").cast("double").alias("depth"),
        count(F.col("host"), ".").cast("double").alias("labels"),
        count(F.col("host"), "-").cast("double").alias("hyphens"),
        (F.length("host") - F.length(F.translate("host", "0123456789", ""))).cast("double").alias("host_digits"),
        ((F.length(u) - F.length(F.translate(u, "0123456789", ""))) / n).alias("digit_ratio"),
        entropy.alias("entropy"),
        F.when(query == "", 0.0).otherwise(count(query, "&") + 1.0).alias("parameters"),
        F.element_at(F.split("host", r"\."), -1).alias("suffix"),
    )


#: Shares of a text's characters, by class, that its quality is judged by.
SHARES = {"letters": r"\p{L}", "digits": r"\p{N}", "blanks": r"\s", "stops": r"[.,;:!?'\"()-]", "capitals": r"\p{Lu}", "symbols": r"[^\p{L}\p{N}\s.,;:!?'\"()-]"}


def _with_text_features(df: DataFrame) -> DataFrame:
    """Add ``said``, the features of ``text`` as one vector."""
    n = F.greatest(F.length("text"), F.lit(1))
    words = F.array_remove(F.split("text", r"\s+"), "")
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    distinct = lambda of: F.size(F.array_distinct(of)) / F.greatest(F.size(of), F.lit(1))
    columns = {k: (F.length("text") - F.length(F.regexp_replace("text", p, ""))) / n for k, p in SHARES.items()}
    columns |= {"size": F.log1p(F.length("text").cast("double")), "word": F.log1p(n / F.greatest(F.size(words), F.lit(1))), "words": distinct(words), "lines": distinct(lines)}
    ready = df.select("*", *(c.alias(f"text_{k}") for k, c in columns.items()))
    return VectorAssembler(inputCols=[f"text_{k}" for k in columns], outputCol="said").transform(ready).select(*df.columns, "said")


def page_text(html: Column) -> Column:
    """What a page shows: scripts, styles, comments and tags are left out, the commonest entities read."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", "\n")
    for entity, said in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(said))
    return text


def labelled_pages(pages: DataFrame, documents: DataFrame, labels: DataFrame, max_documents: int = 2000, max_pages: int = 8000) -> DataFrame:
    """url, label (1: block) of at most ``max_pages`` pages (url, html), those whose urls have the smallest hash.

    A page's text is judged by logistic regression on shares of kinds of characters, lengths and repetition, fitted on
    at most ``max_documents`` documents (doc_id, text) of each label (1: good), those whose ids have the smallest hash.
    Pages without text have no label; without documents of both labels no page has one.
    """
    known = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("label").cast("int").alias("label")).distinct()
    rank = F.xxhash64(F.lit(5), "doc_id")
    good, bad = (known.where(F.col("label") == k).orderBy(rank, "doc_id").limit(max_documents) for k in (1, 0))
    found = documents.select("doc_id", "text").where("text <> ''").join(F.broadcast(good.union(bad)), "doc_id")
    sample = materialize(_with_text_features(found.orderBy(rank, "doc_id", "text").limit(2 * max_documents).select("text", "label")).select("said", "label"), "documents")
    shown = pages.where("url IS NOT NULL AND html IS NOT NULL").select("url", "html")
    taken = shown.select("url").distinct().orderBy(F.xxhash64("url", F.lit(11)), "url").limit(max_pages)  # urls alone are sorted
    shown = shown.join(F.broadcast(taken), "url").groupBy("url").agg(F.min("html").alias("html"))
    shown = shown.select("url", page_text(F.col("html")).alias("text")).where(F.trim("text") != "")
    counts = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(counts) < 2:
        return shown.limit(0).select("url", F.lit(0).alias("label"))
    weighed = sample.withColumn("weight", F.when(F.col("label") == 1, 1 / counts[1]).otherwise(1 / counts[0]) * sum(counts.values()) / 2)
    model = LogisticRegression(featuresCol="said", labelCol="label", weightCol="weight", regParam=1e-3, maxIter=50, predictionCol="good").fit(weighed.coalesce(1))
    out = materialize(model.transform(_with_text_features(shown)).select("url", (F.col("good") == 0).cast("int").alias("label")), "labelled")
    discard(sample)
    return out


class UrlModel:
    """Boosted trees and the suffix statistics that they were trained with."""

    def __init__(self, trees: GBTClassificationModel | None, suffixes: dict[str, float], prior: float) -> None:
        self.trees, self.suffixes, self.prior = trees, suffixes, prior

    def _suffix_rate(self) -> Column:
        rate = F.lit(self.prior)
        for suffix, value in self.suffixes.items():
            rate = F.when(F.col("suffix") == suffix, F.lit(value)).otherwise(rate)
        return rate

    def score(self, df: DataFrame, url: str = "url") -> DataFrame:
        """Add score, the probability of block; df has host and path."""
        if self.trees is None:
            return df.withColumn("score", F.lit(0.0))
        kept = df.columns
        ready = lexical_features(df, url).withColumn("suffix_rate", self._suffix_rate())
        vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(ready)
        scored = self.trees.transform(vectors).withColumn("score", vector_to_array("_probability")[1])
        return scored.select(*kept, "score")


def train(labelled: DataFrame, max_rows: int = 8000, max_suffixes: int = 50, trees: int = 12, depth: int = 3) -> UrlModel:
    """Fit on url, label (1: block): at most ``max_rows`` urls, those with the smallest hash, so any size trains alike.

    Suffix statistics: the smoothed block rate of the ``max_suffixes`` commonest suffixes among them.
    """
    known = labelled.where(F.col("url").isNotNull() & F.col("label").isNotNull()).select("url", F.col("label").cast("int"))
    sample = materialize(known.distinct().orderBy(F.xxhash64("url", F.lit(11)), "url", "label").limit(max_rows), "urls")
    rows, bad = sample.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not rows or bad in (0, rows):
        return UrlModel(None, {}, 0.0)
    ready = lexical_features(with_parts(sample.coalesce(1)))
    prior = bad / rows
    stats = ready.groupBy("suffix").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("bad"))
    top = stats.orderBy(F.desc("n"), "suffix").limit(max_suffixes).collect()
    model = UrlModel(None, {r.suffix: (r.bad + 20 * prior) / (r.n + 20) for r in top}, prior)
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(ready.withColumn("suffix_rate", model._suffix_rate()))
    boosting = GBTClassifier(featuresCol="_features", labelCol="label", predictionCol="_prediction", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=3)
    boosting = boosting.setProbabilityCol("_probability").setRawPredictionCol("_raw")
    model.trees = boosting.fit(vectors.select("_features", "label"))
    discard(sample)
    return model


def held_out(labelled: DataFrame, parts: int = 3, threshold: float = 0.5) -> dict[tuple[int, int], int]:
    """(label, predicted): rows, of the urls whose host falls into one of ``parts`` by its hash, by a model of the others."""
    split = with_parts(labelled).withColumn("part", F.pmod(F.xxhash64(F.lit(3), "host"), F.lit(parts)))
    model = train(split.where("part > 0"))
    told = model.score(split.where("part = 0")).groupBy("label", (F.col("score") >= threshold).cast("int").alias("predicted")).count()
    return {(r.label, r.predicted): r["count"] for r in told.collect()}


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules: tuple[tuple[str, str], ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """Each page's host, path, rule, verdict and score.

    Trained on ``labelled`` (url, label 1: block), or without it on the urls that a rule decides.
    """
    rule, verdict = fitting_rule(rules)
    split = with_parts(pages.select("page_id", "url")).select("*", rule.alias("rule"), verdict.alias("_said"))
    ruled = split.where("_said IS NOT NULL").select("url", (F.col("_said") == "block").cast("int").alias("label"))
    model = train(ruled if labelled is None else labelled)
    scored = model.score(split)
    made = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("_said", made).alias("verdict"), "score")
