"""Line dedup by site-relative frequency.

Pages are grouped by host; a line's ratio is the number of the host's pages that repeat it (those that contain it, but
for one) divided by all of the host's pages. Lines whose ratio is above ``ratio`` are boilerplate and dropped from every
page of that host. On a large host that is the share of pages with the line; on a small one the page that has it first
does not count, so a line of one page is never boilerplate and hosts of two pages or more are all cleaned alike.

Counting is by 64-bit hash first, with partial sums before the shuffle, so a host with a third of all pages is spread
over its lines; only lines whose hash passes are counted again by their text, which makes the result exact. A host can
have at most (lines a page) / ratio such lines, so they travel to its pages as one array, and a join that Spark splits
when a host is large brings them together.

Lines are what ``\\n`` separates; they are compared without blanks at their ends, and blank lines are never counted or
dropped. Null text stays null. Null hosts are one host. Each row is a page, repeated rows too; a line counts once a
page. An empty table gives no rows. Extra columns of any name stay, but for n_lines and n_dropped, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewright.llm.common import free_name, materialize, tasks_for


def _lines(text: str) -> Column:
    """The distinct lines of a page that count."""
    cut = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x))
    return F.array_distinct(F.filter(cut, lambda x: x != ""))


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = 0.05) -> DataFrame:
    """_host (struct of the host), line, pages (with it), total (of the host): the lines above the ratio."""
    named = pages.select(F.struct(F.col(f"`{host}`").alias("name")).alias("_host"), _lines(f"`{text}`").alias("lines"))
    totals = named.groupBy("_host").agg(F.count(F.lit(1)).alias("total"))
    frequent = lambda counted: F.col(counted) - 1 > F.col("total") * F.lit(ratio)
    hashes = named.select("_host", F.explode(F.transform("lines", lambda x: F.xxhash64(x))).alias("hash"))
    heavy = hashes.groupBy("_host", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").join(totals, "_host").where(frequent("n"))
    heavy = materialize(heavy.select("_host", "hash", "total"), "heavy", tasks_for(pages, 0.1))
    texts = named.select("_host", F.explode("lines").alias("line")).withColumn("hash", F.xxhash64("line"))
    counted = texts.join(heavy, ["_host", "hash"]).groupBy("_host", "line", "total").agg(F.count(F.lit(1)).alias("pages"))
    return counted.where(frequent("pages")).select("_host", "line", "pages", "total")


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", **how) -> DataFrame:
    """All pages and columns, the text without boilerplate lines, and n_lines, n_dropped."""
    pages = pages.drop("n_lines", "n_dropped")
    of, bad, lines, kept = (free_name(pages.columns, f"_{x}") for x in ("host", "bad", "lines", "kept"))
    found = boilerplate(pages, host, text, **how).groupBy("_host").agg(F.collect_list("line").alias(bad)).withColumnRenamed("_host", of)
    found = materialize(found, "boilerplate", tasks_for(pages, 0.1))
    both = pages.withColumn(of, F.struct(F.col(f"`{host}`").alias("name"))).join(found, of, "left")
    cut = both.withColumn(lines, F.split(F.col(f"`{text}`"), "\n"))
    keep = F.when(F.col(bad).isNull(), F.col(lines)).otherwise(F.filter(lines, lambda x: ~F.array_contains(bad, F.trim(x))))
    done = cut.withColumn(kept, keep)
    n = lambda x: F.greatest(F.coalesce(F.size(x), F.lit(0)), F.lit(0)).cast("long")
    out = [F.when(F.col(f"`{c}`").isNotNull(), F.concat_ws("\n", kept)).alias(c) if c == text else F.col(f"`{c}`") for c in pages.columns]
    return done.select(*out, n(lines).alias("n_lines"), (n(lines) - n(kept)).alias("n_dropped"))
