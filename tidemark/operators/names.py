"""Nearest names by edit distance, through segments that close names share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import name_ratio
from tidemark.plans.lineage import cut


def _segments(frame: DataFrame, most: int, least: float) -> DataFrame:
    """One row for each segment (i, begin, width) of a name of length m, and errors: the edits that leave one of them whole.

    A ratio of ``least`` allows (1 - least) / least * m edits at most, which is less than m."""
    allowed = F.floor(F.col("m") * ((1 - least) / least) + 1e-9).cast("int")
    cut_up = frame.withColumn("errors", F.least(F.lit(most), allowed)).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("errors"))))
    edge = lambda i: F.floor(i * F.col("m") / (F.col("errors") + 1)).cast("int")
    return cut_up.withColumn("begin", edge(F.col("i"))).withColumn("width", edge(F.col("i") + 1) - F.col("begin"))


def close_names(queries: DataFrame, names: DataFrame, most: int, least: float) -> DataFrame:
    """q, name, s of all pairs at most ``most`` edits apart with a ratio of ``least`` or more (others may be among them).

    A name is cut into one segment more than edits are allowed, so one is whole in the query:
    with i segments before it, at most i places from its own, counted from the front, and at most
    as many as segments follow, counted from the back.  Only equal segments meet."""
    n = F.length("q")
    kept = _segments(names.select("name", F.length("name").alias("m")), most, least).select("name", "m", "i", F.expr("substring(name, begin + 1, width)").alias("segment"))
    low = F.greatest(n - most, F.ceil(n * least - 1e-9).cast("int"))
    high = F.least(n + most, F.floor(n / least + 1e-9).cast("int"))
    sought = _segments(queries.withColumn("m", F.explode(F.sequence(low, high))), most, least).withColumn("longer", n - F.col("m"))
    after = F.col("errors") - F.col("i")
    sought = sought.withColumns({"first": F.greatest(-F.col("i"), F.col("longer") - after), "last": F.least(F.col("i"), F.col("longer") + after)}).filter("first <= last")
    sought = sought.withColumn("at", F.explode(F.sequence(F.col("begin") + F.col("first"), F.col("begin") + F.col("last")))).filter((F.col("at") >= 0) & (F.col("at") + F.col("width") <= n))
    sought = sought.select("q", "m", "i", F.expr("substring(q, at + 1, width)").alias("segment")).distinct()
    pairs = sought.join(kept, ["m", "i", "segment"]).select("q", "name").distinct()
    return pairs.withColumn("s", name_ratio(F.col("q"), F.col("name"))).filter(F.col("s") >= least)


def nearest_names(queries: DataFrame, names: DataFrame, least: float = 0.6) -> DataFrame:
    """q, name, s: the name with the greatest ratio (``name_ratio``) for each query, of ``least`` (over 0.5) or more; ties go to the smaller name.

    Names up to one edit away are looked up first, then two, four and so on, for queries that a
    name farther off could still suit better, so each answer is exact.  Null and empty strings
    match nothing; repeated queries and names count once."""
    if not 0.5 < least <= 1:
        raise ValueError("least must be over 0.5 and at most 1")
    pending = cut(queries.select("q").filter(F.length("q") > 0).distinct())
    known = cut(names.select("name").filter(F.length("name") > 0).distinct())
    found, most, n = None, 1, F.length("q")
    while True:
        best = close_names(pending, known, most, least).groupBy("q").agg(F.min(F.struct((-F.col("s")).alias("s"), "name")).alias("best"))
        beyond = 1 - (most + 1) / (n + most + 1)  # no name with more edits has a greater ratio
        sure = F.coalesce(-F.col("best.s") > beyond + 1e-12, F.lit(False)) | (F.floor(n * ((1 - least) / least) + 1e-9) <= most)
        step = cut(pending.join(best, "q", "left").withColumn("sure", sure))
        got = step.filter("sure AND best IS NOT NULL").select("q", "best.name", (-F.col("best.s")).alias("s"))
        found = got if found is None else found.unionByName(got)
        pending, most = step.filter("NOT sure").select("q"), most * 2
        if pending.isEmpty():
            return found
