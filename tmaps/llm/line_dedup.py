"""Line dedup by site-relative frequency.

Pages are grouped by host. A line's frequency is the number of the host's pages that hold
it, divided by all pages of the host; lines above a boilerplate ratio, on at least
``LEAST_PAGES`` pages, are dropped wherever they stand on the host.

Lines are compared by 96 bits of hashes of their trimmed text. Each page counts a line
once, pages are counted before the shuffle, and a host's list of dropped lines is at most
(distinct lines of a page, on average) / ratio long, so it is joined to the pages as one
row a host, or as one for each part of a host with very many pages.

Defined cases: null and empty texts have no lines and stay empty; blank lines are kept and
never counted; a null host is a host of its own; a line repeated on one page counts once;
repeated rows are pages of their own; an empty table gives no rows; the columns host, text
and the page's id are named by the caller, further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATIO, LEAST_PAGES = 0.3, 3
HOT = 1000


def _lines(text):
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n", -1))


def _key(line):
    trimmed = F.trim(line)
    return F.struct(F.xxhash64(trimmed).alias("a"), F.hash(trimmed).alias("b"))


def drop_boilerplate(pages: DataFrame, page: str, host: str, text: str, ratio: float = RATIO,
                     least_pages: int = LEAST_PAGES) -> DataFrame:
    """The page's id, host, text without boilerplate lines, n_lines, n_dropped."""
    rows = pages.select(F.col(page).alias("page"), F.col(host).alias("host"), _lines(F.coalesce(F.col(text), F.lit(""))).alias("lines"))
    total = rows.groupBy("host").agg(F.count("*").alias("pages")).withColumnRenamed("host", "of")
    seen = rows.select("host", F.explode(F.array_distinct(F.transform(F.filter("lines", lambda x: F.trim(x) != ""), _key))).alias("line"))
    counts = seen.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    often = (counts.join(total, F.col("host").eqNullSafe(F.col("of")))
             .where(F.col("n") > ratio * F.col("pages")).groupBy("host").agg(F.collect_list("line").alias("drop"))
             .withColumnRenamed("host", "of"))
    # hosts of more than a thousandth of all pages (so at most HOT of them) are split into
    # parts of about that size; their lists are repeated for each part
    share = F.ceil(F.lit(total.agg(F.sum("pages")).first()[0] or 1) / HOT)
    hot = total.where(F.col("pages") > share).select(F.col("of").alias("hot_host"), F.ceil(F.col("pages") / share).cast("int").alias("parts"))
    split = lambda df, host: df.join(F.broadcast(hot), F.col(host).eqNullSafe(F.col("hot_host")), "left").withColumn(
        "parts", F.coalesce("parts", F.lit(1))).drop("hot_host")
    rows = split(rows, "host").withColumn("part", F.pmod(F.xxhash64("page", F.size("lines")), F.col("parts")).cast("int"))
    often = split(often, "of").withColumn("of_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    kept = F.when(F.col("drop").isNull(), F.col("lines")).otherwise(
        F.filter("lines", lambda x: (F.trim(x) == "") | ~F.array_contains("drop", _key(x))))
    mine = F.col("host").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part"))
    out = rows.join(often, mine, "left").withColumn("kept", kept)
    return out.select(F.col("page").alias(page), F.col("host").alias(host), F.array_join("kept", "\n").alias("text"),
                      F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"))
