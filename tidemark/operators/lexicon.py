"""Terms of a dictionary table in texts.

A text is cut into pieces: runs of letters, digits and underscores, and single other
characters.  A term can only start where a piece starts, so an index of the terms' first
pieces, with the lengths of the terms that start so, says which stretches of a text to look
up; each is met with the terms by equality.  A position costs as many look-ups as its first
piece has lengths, however many terms the dictionary holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.lineage import cut

PIECE, WORD = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]", r"^[\p{L}\p{N}_]"
#: Bytes of a dictionary's terms up to which it is sent to every executor; a larger one is shuffled.
BROADCAST_BYTES = 32 << 20


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({PIECE})"), 1)


def is_word(piece: Column) -> Column:
    return F.coalesce(piece.rlike(WORD), F.lit(False))


def found_terms(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """id, kind, start, size, term, canonical, found: where the terms (kind, term, canonical, cased, closed) stand in texts (id, text).

    Start and size count pieces.  A term is found whole: no letter, digit or underscore touches
    it, and none and no dot if it is ``closed``; in any case, unless it is ``cased``.  Of the terms
    of a kind the one that starts first is taken, of those the longest, and the next one starts
    after it.  Equal terms of a kind give the smallest canonical name.  Null texts hold nothing;
    null and blank terms are left out."""
    bare = F.trim("term")
    known = terms.filter(bare != "").select("kind", bare.alias("term"), "canonical", F.coalesce("cased", F.lit(False)).alias("cased"), F.coalesce("closed", F.lit(False)).alias("closed"))
    known = known.withColumn("key", F.lower("term")).withColumn("exact", F.when(F.col("cased"), F.col("term")))
    known = known.groupBy("kind", "key", "exact", "closed").agg(F.min_by(F.struct("term", "canonical"), F.struct("canonical", "term")).alias("t")).select("kind", "key", "exact", "closed", "t.term", "t.canonical")
    known = cut(known.withColumn("cut", pieces(F.col("term"))).withColumn("size", F.size("cut")))
    extent = known.agg(F.sum(F.octet_length("term") * 2 + 64).alias("bytes"), F.max("size").alias("longest")).first()
    small = (lambda f: F.broadcast(f)) if (extent["bytes"] or 0) <= BROADCAST_BYTES else (lambda f: f)
    longest = extent["longest"] or 1
    index = known.groupBy(F.lower(F.get("cut", F.lit(0))).alias("first")).agg(F.array_sort(F.collect_set("size")).alias("sizes"))

    cut_up = texts.filter("text IS NOT NULL").select("id", pieces(F.col("text")).alias("p"))
    places = cut_up.filter(F.size("p") > 0).select("id", "p", F.explode(F.sequence(F.lit(0), F.size("p") - 1)).alias("start"))
    before = F.get("p", F.col("start") - 1)
    places = places.select("id", "start", before.alias("before"), F.lower(F.get("p", "start")).alias("first"), F.slice("p", F.col("start") + 1, F.lit(longest + 1)).alias("ahead"))
    places = places.filter((F.trim("first") != "") & ~is_word(F.col("before"))).join(small(index), "first")
    tried = places.select("id", "start", "before", "ahead", F.explode("sizes").alias("size")).filter(F.size("ahead") >= F.col("size"))
    tried = tried.select("id", "start", "before", "size", F.array_join(F.slice("ahead", F.lit(1), F.col("size")), "").alias("found"), F.get("ahead", "size").alias("after"))
    tried = tried.filter(~is_word(F.col("after")) | ~is_word(F.substring("found", -1, 1))).withColumn("key", F.lower("found"))
    dotted = F.coalesce(F.col("before") == ".", F.lit(False)) | F.coalesce(F.col("after") == ".", F.lit(False))
    whole = ~is_word(F.col("after")) & (F.col("exact").isNull() | (F.col("exact") == F.col("found"))) & ~(F.col("closed") & dotted)
    met = tried.join(small(known.drop("cut", "size")), "key").filter(whole)
    # One shuffle by text and kind; what follows keeps its order.  Matches that overlap no others, which
    # most are, form an island of their own; only islands of several are walked from match to match.
    text = Window.partitionBy("id", "kind").orderBy("start")
    longest_first = F.min(F.struct((-F.col("size")).alias("less"), "canonical", "term", "size", "found")).alias("m")
    best = met.repartition("id", "kind").groupBy("id", "kind", "start").agg(longest_first).select("id", "kind", "start", "m.size", "m.term", "m.canonical", "m.found")
    reach = F.max(F.col("start") + F.col("size")).over(text.rowsBetween(Window.unboundedPreceding, -1))
    apart = best.withColumn("_new", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int"))
    apart = apart.withColumn("_island", F.sum("_new").over(text.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    match = F.struct("start", "size", "term", "canonical", "found")
    islands = apart.groupBy("id", "kind", "_island").agg(F.array_sort(F.collect_list(match)).alias("all"))
    shape = islands.schema["all"].dataType.elementType.simpleString()
    first = F.struct(F.lit(0).alias("stop"), F.array().cast(f"array<{shape}>").alias("kept"))
    step = lambda s, x: F.when(x["start"] >= s["stop"], F.struct((x["start"] + x["size"]).alias("stop"), F.concat(s["kept"], F.array(x)).alias("kept"))).otherwise(s)
    kept = F.when(F.size("all") == 1, F.col("all")).otherwise(F.aggregate("all", first, step)["kept"])
    return islands.select("id", "kind", F.explode(kept).alias("m")).select("id", "kind", "m.*")


def entities(texts: DataFrame, terms: DataFrame, fields: dict[str, list[str]], fallbacks: dict[str, dict[str, list[str]]]) -> DataFrame:
    """id and one array for each of ``fields``: the terms of its kinds as the text writes them, kind after kind in the order given, each once in any case.

    A field without a term takes the names of all its ``fallbacks`` (pattern to names) that the
    lower-cased text has, each once in any case.  Ids are unique; null texts count as empty."""
    order = F.create_map(*(F.lit(x) for kinds in fields.values() for i, k in enumerate(kinds) for x in (k, i)))
    named = F.create_map(*(F.lit(x) for field, kinds in fields.items() for k in kinds for x in (k, field)))
    met = found_terms(texts, terms).withColumns({"field": named[F.col("kind")], "rank": order[F.col("kind")]}).filter("field IS NOT NULL")
    once = met.groupBy("id", "field", F.lower("found").alias("key")).agg(F.min(F.struct("rank", "start", "found")).alias("m"))
    names = lambda f: F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == f, F.col("m")))), lambda m: m["found"])
    row = once.groupBy("id").agg(*(names(f).alias(f"_{f}") for f in fields))
    low = F.lower(F.coalesce("text", F.lit("")))
    none = F.array().cast("array<string>")

    def hinted(field: str) -> Column:
        given = [F.when(low.rlike("(?U)" + p), F.array(*map(F.lit, names))).otherwise(none) for p, names in fallbacks.get(field, {}).items()]
        return F.array_distinct(F.concat(*given)) if given else none

    fill = {f: F.when(F.size(F.coalesce(f"_{f}", none)) > 0, F.col(f"_{f}")).otherwise(hinted(f)) for f in fields}
    return texts.join(row, "id", "left").select("id", *(c.alias(f) for f, c in fill.items()))
