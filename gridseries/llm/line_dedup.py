"""Line dedup by site-relative frequency, in DataFrame operations only.

A page's lines are its text split at ``\\n``; a line's key is the line without
blanks, tabs and carriage returns at its ends, and lines with an empty key are
never counted or dropped.  Per host, the pages that hold a line at least once
are divided by all pages of the host; a line on more than ``ratio`` of them (and
on at least ``min_pages``) is boilerplate of that host and goes from all of its
pages, every occurrence of it.

Plan: lines are counted once per page (distinct inside the row) and combined on
the map side, so a line or host that a third of all rows share costs a few rows
per task; lines travel as two 64-bit hashes.  Boilerplate lines are found back
by an equi-join on (host, line) with the page's light rows (skew is split by
AQE, small sides are broadcast by AQE at their measured size), positions are
grouped by page and joined to the pages by page key.  No Python, no broadcast
hint, no window, no cross join.  Lost executors re-run tasks of the shuffles.

Defined cases: a null text is the empty text; pages without a host form one
host of their own; repeated rows count as pages of their own and lose the same
lines; a page may end up with an empty text but its row stays; an empty table
gives an empty table; other columns pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridseries.llm.common import quoted

RATIO = 0.1
MIN_PAGES = 5


def line_key(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _hashes(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("line"), key).alias("b"))


def _rows(pages: DataFrame, host_col: str, text_col: str) -> DataFrame:
    """Page key, host and lines of every page.  Pages of equal host and text share a key: they lose the same lines."""
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    host = quoted(host_col).cast("string")
    return pages.select(F.struct(F.xxhash64(host, text).alias("a"), F.xxhash64(F.lit("page"), text, host).alias("b")).alias("__page"),
                        host.alias("__host"), F.split(text, "\n").alias("__lines"))


def boilerplate(pages: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO,
                min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line, n_pages, host_pages): the hashes of each host's boilerplate lines and how often they occur."""
    rows = _rows(pages, host_col, text_col)
    keys = F.array_distinct(F.filter(F.transform("__lines", line_key), lambda k: k != ""))
    counts = rows.select("__host", F.explode(F.transform(keys, _hashes)).alias("line")) \
        .groupBy("__host", "line").agg(F.count(F.lit(1)).alias("n_pages")).filter(F.col("n_pages") >= min_pages)
    totals = rows.groupBy("__host").agg(F.count(F.lit(1)).alias("host_pages"))
    both = counts.join(totals.withColumnRenamed("__host", "__h"), F.col("__host").eqNullSafe(F.col("__h")))
    return both.filter(F.col("n_pages") > F.col("host_pages") * F.lit(ratio)) \
        .select(F.col("__host").alias("host"), "line", "n_pages", "host_pages")


def drop_boilerplate(pages: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO,
                     min_pages: int = MIN_PAGES) -> DataFrame:
    """``pages`` with the boilerplate lines taken out of ``text_col``, and two columns more: __n_lines, __n_dropped."""
    bad = boilerplate(pages, host_col, text_col, ratio, min_pages).select("host", "line")
    at = _rows(pages, host_col, text_col).select("__page", "__host", F.posexplode("__lines").alias("pos", "l")) \
        .select("__page", "__host", "pos", line_key(F.col("l")).alias("k")).filter("k <> ''") \
        .select("__page", "__host", "pos", _hashes(F.col("k")).alias("line"))
    hits = at.join(bad.withColumnRenamed("line", "bad"), F.col("__host").eqNullSafe(F.col("host")) & (F.col("line") == F.col("bad")))
    by_page = hits.groupBy("__page").agg(F.collect_set("pos").alias("__bad"))  # a page's own lines, once
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    host = quoted(host_col).cast("string")
    keyed = pages.withColumn("__page", F.struct(F.xxhash64(host, text).alias("a"), F.xxhash64(F.lit("page"), text, host).alias("b")))
    lines = F.split(text, "\n")
    joined = keyed.join(by_page, "__page", "left").withColumn("__n_lines", F.size(lines)) \
        .withColumn("__n_dropped", F.coalesce(F.array_size("__bad"), F.lit(0)))
    # inside a lambda: the array steps are evaluated as they are, outside the join's generated code (with them in it, executors' memory jumped in that stage)
    cut = F.expr("""transform(array(struct(__split AS l, __bad AS bad)), x -> array_join(
        transform(array_except(sequence(0, size(x.l) - 1), x.bad), p -> x.l[p]), '\n'))[0]""")
    return joined.withColumn("__split", F.when(F.col("__n_dropped") > 0, lines)) \
        .withColumn(text_col, F.when(F.col("__n_dropped") > 0, cut).otherwise(quoted(text_col).cast("string"))) \
        .select(*[quoted(c) for c in pages.columns], "__n_lines", "__n_dropped")
