"""Planning of searches whose results are counted by day: date windows that hold no more records than one search can fetch."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The dates a search reaches over, and how many records a window can fetch.
EARLIEST, LATEST, LIMIT = datetime.date(1000, 1, 1), datetime.date(3000, 12, 31), 9999


def date_windows(counts: DataFrame, limit: int = LIMIT, earliest: datetime.date = EARLIEST, latest: datetime.date = LATEST) -> DataFrame:
    """(query, lo, hi, n, too_many) from counts (query, day, n): windows of at most `limit` records.

    The whole range is halved until its parts hold no more, as a source that tells counts of ranges alone would be asked; windows
    without records are left out, and a single day over the limit is one window, too_many. Every day lies in one part
    of each depth, so one aggregate counts all parts there can be, and a part is a window if it fits and the part around it doesn't.
    """
    last = (latest - earliest).days
    by_day = counts.groupBy("query", F.datediff(F.col("day"), F.lit(earliest)).alias("d")).agg(F.sum("n").alias("n")).where((F.col("d") >= 0) & (F.col("d") <= last) & (F.col("n") > 0))
    part = lambda lo, hi, of_lo, of_hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), of_lo.cast("int").alias("of_lo"), of_hi.cast("int").alias("of_hi"))
    none = F.lit(None)
    whole = F.array(part(F.lit(0), F.lit(last), none, none))

    def halved(parts):
        p = F.element_at(parts, -1)
        middle = p["lo"] + F.floor((p["hi"] - p["lo"]) / 2)
        left = F.col("d") <= middle
        half = part(F.when(left, p["lo"]).otherwise(middle + 1), F.when(left, middle).otherwise(p["hi"]), p["lo"], p["hi"])
        return F.when(p["lo"] < p["hi"], F.concat(parts, F.array(half))).otherwise(parts)

    parts = F.aggregate(F.sequence(F.lit(1), F.lit(last.bit_length() + 1)), whole, lambda found, _: halved(found))
    counted = by_day.select("query", "n", F.explode(parts).alias("p")).groupBy("query", "p.lo", "p.hi", "p.of_lo", "p.of_hi").agg(F.sum("n").alias("n"))
    around = counted.select("query", F.col("lo").alias("of_lo"), F.col("hi").alias("of_hi"), F.col("n").alias("of_n"))
    fits = counted.join(around, ["query", "of_lo", "of_hi"], "left").where(((F.col("n") <= limit) | (F.col("lo") == F.col("hi"))) & (F.col("of_n").isNull() | (F.col("of_n") > limit)))
    day = lambda c: F.date_add(F.lit(earliest), F.col(c)).alias(c)
    return fits.select("query", day("lo"), day("hi"), "n", (F.col("n") > limit).alias("too_many"))


def fetches(windows: DataFrame, batch: int = 500) -> DataFrame:
    """(query, lo, hi, start, records): the batches in which the records of each window are fetched."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(batch).cast("long"))).alias("start")
    return windows.where("n > 0").select("query", "lo", "hi", "n", starts).select("query", "lo", "hi", "start", F.least(F.lit(batch), F.col("n") - F.col("start")).alias("records"))
