"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Documents are counted into cells (source, language, topic) with their tokens.  Raking
scales the cells' token weights, in turn for each of the three, until their sums are the
target weights to within TOLERANCE; the weight of a cell over its tokens says how often its
documents are wanted.  Probabilities are those ratios over the largest one, so that the
expected tokens of the sample have the target shares; a document is drawn if a hash of its
id is below.  Rounds go on as long as the residual falls, however slowly; targets that no
weights of the cells can meet are told by a residual that doesn't: it is a column of
``rake``, and a warning.

The topic of a document is a column that the caller names; without one it is a rough form
of the text (``form``).

Only cells are raked, and their number grows with the categories, not with documents.  Up
to SMALL_CELLS of them they are raked as the arrays of one row; beyond, each step adds up
and joins categories, and hot ones are dealt out.

Defined cases: null sources, languages and topics are categories of their own, ``(none)``;
a null, empty or blank text weighs one token; a very long one is counted whole, in one pass;
targets of categories without documents are dropped and the rest scaled up; categories
without a target get none and are never drawn; rows that repeat a doc_id are drawn
together, as are those without one; an empty table gives no rows; other columns don't
matter, whatever their names, and ``sample`` keeps them.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, join_back

DIMENSIONS = ("source", "lang", "topic")
ROUNDS, LOOK = 12, 100  # rounds before the first look at the residual, and between others
STALLED = 0.01  # a residual that falls by less between two looks falls no more
TOLERANCE = 1e-6  # of the sum of all weights, 1
TEMPER = 0.9  # default targets: token shares to this power
SMALL_CELLS = 50_000
SEED = "mix-1"

# White space of the word contract; marks of forms.  No pattern begins with a run, whose search in a long word without the rest would take the square of its length.
WORD = r"[^\x20\x09-\x0D]+"
LICENCE = ("license", "licence", "copyright")
MAIL, PHONE = r"[A-Za-z0-9._-]@[A-Za-z0-9-]+\.[a-z]", r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}"


def form(text: Column, tokens: Column) -> Column:
    """A rough form of a text: licence, table, contact, note or prose.  The patterns are looked for only where their rarest sign is."""
    low = F.lower(text)
    licence = low.contains(LICENCE[0]) | low.contains(LICENCE[1]) | low.contains(LICENCE[2])
    bars = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    contact = (text.contains("@") & F.regexp_like(text, F.lit(MAIL))) | (text.contains("(") & F.regexp_like(text, F.lit(PHONE)))
    return F.when(licence, "licence").when(bars * 20 > tokens, "table").when(contact, "contact").when(tokens < 100, "note").otherwise("prose")


def features(documents: DataFrame, topic: str | None = None) -> DataFrame:
    """row (the document's own columns), doc_id, source, lang, topic, tokens of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("(none)")).alias(c if c in DIMENSIONS else "topic")
    words = F.greatest(F.regexp_count(text, F.lit(WORD)), F.lit(1)).cast("long").alias("tokens")
    out = documents.select(F.struct("*").alias("row"), "doc_id", name("source"), name("lang"), words, text.alias("text") if topic is None else name(topic))
    return out if topic else out.withColumn("topic", form(F.col("text"), F.col("tokens"))).drop("text")


def default_targets(cells: DataFrame, dimension: str) -> DataFrame:
    """name, target: the tempered token shares of a dimension."""
    sums = cells.groupBy(F.col(dimension).alias("name")).agg(F.sum("tokens").cast("double").alias("t"))
    return sums.select("name", F.pow("t", F.lit(TEMPER)).alias("target"))


def with_targets(cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """cells with target_source, target_lang, target_topic: shares of 1 among the categories that occur; null without a target."""
    for d in DIMENSIONS:
        wanted = targets[d] if d in targets else default_targets(cells, d)
        there = cells.groupBy(F.col(d).alias("name")).agg(F.count("*").alias("n"))
        wanted = cut(there.join(wanted.select("name", F.col("target").cast("double").alias("target")), "name").select(F.col("name").alias(d), "target", "n"))
        total = wanted.agg(F.sum("target")).first()[0] or 1.0
        cells = join_back(cells, wanted.select(d, (F.col("target") / total).alias(f"target_{d}"), "n"), d, "n", DIMENSIONS).drop("n")
    return cells


def scaled(cells: DataFrame, d: str) -> DataFrame:
    """The cells with weights scaled to a dimension's targets, where all cells needn't fit into one task."""
    sums = cut(cells.groupBy(d).agg(F.sum("weight").alias("total"), F.count("*").alias("n")))
    joined = join_back(cells, sums, d, "n", DIMENSIONS)
    return cut(joined.withColumn("weight", F.when(F.col("total") > 0, F.col("weight") * F.col(f"target_{d}") / F.col("total")).otherwise(0.0)).drop("total", "n"))


def residual(cells: DataFrame) -> float:
    """How far the sum of a category's weights is from its target, at most."""
    parts = [cells.filter(F.col(f"target_{d}").isNotNull()).groupBy(d).agg((F.sum("weight") - F.max(f"target_{d}")).alias("off")).agg(F.max(F.abs("off"))).first()[0] for d in DIMENSIONS]
    return max((p for p in parts if p is not None), default=0.0)


def gathered(cells: DataFrame) -> DataFrame:
    """At most SMALL_CELLS cells in one row: cells (all of them, in order), w (their weights), dims (for each dimension a cell's category, a category's cells and its target)."""
    place = F.row_number().over(Window.orderBy(*DIMENSIONS)) - 1
    placed = cells.select("*", place.alias("i"), *((F.dense_rank().over(Window.orderBy(d)) - 1).alias(f"at_{d}") for d in DIMENSIONS))
    placed = cut(placed)
    row = placed.agg(F.sort_array(F.collect_list(F.struct("i", F.struct(*cells.columns).alias("cell"), *(f"at_{d}" for d in DIMENSIONS)))).alias("all"))
    row = row.select(F.transform("all", lambda x: x["cell"]).alias("cells"), *(F.col("all")[f"at_{d}"].alias(f"at_{d}") for d in DIMENSIONS))
    for d in DIMENSIONS:
        lists = placed.groupBy(f"at_{d}").agg(F.sort_array(F.collect_list("i")).alias("own"), F.max(f"target_{d}").alias("target"))
        row = row.crossJoin(lists.agg(F.sort_array(F.collect_list(F.struct(f"at_{d}", "own", "target"))).alias(f"lists_{d}")))
    parts = [F.struct(F.col(f"at_{d}").alias("at"), F.transform(f"lists_{d}", lambda x: x["own"]).alias("own"), F.transform(f"lists_{d}", lambda x: x["target"]).alias("target")) for d in DIMENSIONS]
    return row.select("cells", F.transform("cells", lambda x: x["weight"]).alias("w"), F.array(*parts).alias("dims"))


def category_sums(w: Column, dim: Column) -> Column:
    return F.transform(dim["own"], lambda own: F.aggregate(own, F.lit(0.0), lambda total, i: total + F.get(w, i)))


def raked_rounds(row: DataFrame, rounds: int) -> DataFrame:
    """The row of ``gathered`` after some rounds, with off: how far a category is from its target, at most.

    A step sums the categories of one dimension and scales its cells, each in one pass over them."""

    def step(w: Column, n: Column) -> Column:
        dim = F.get("dims", n % len(DIMENSIONS))
        factors = F.zip_with(category_sums(w, dim), dim["target"], lambda total, target: F.when(total > 0, F.coalesce(target, F.lit(0.0)) / total).otherwise(0.0))
        # A lambda's variable holds what was worked out once.
        return F.aggregate(F.array(factors), w, lambda was, factor: F.transform(was, lambda x, i: x * F.get(factor, F.get(dim["at"], i))))

    row = cut(row.select("cells", "dims", F.aggregate(F.sequence(F.lit(0), F.lit(len(DIMENSIONS) * rounds - 1)), F.col("w"), step).alias("w")))
    off = F.transform("dims", lambda dim: F.array_max(F.zip_with(category_sums(F.col("w"), dim), dim["target"], lambda total, target: F.abs(total - target))))
    return row.withColumn("off", F.coalesce(F.array_max(off), F.lit(0.0)))


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """The cells (source, lang, topic, tokens) with weight, fitted token weights whose sum is 1, and residual: how far a category still is from its target, at most.

    Rounds go on until the residual is TOLERANCE, or falls no more: by less than STALLED in
    LOOK rounds.  Then the targets contradict each other on these cells, the residual says by
    how much, and a warning too."""
    out = cut(with_targets(cells, targets or {}))
    small = out.count() <= SMALL_CELLS
    wanted = F.col("target_source").isNotNull() & F.col("target_lang").isNotNull() & F.col("target_topic").isNotNull()
    out = out.withColumn("weight", F.when(wanted, F.col("tokens").cast("double")).otherwise(0.0))
    out = gathered(out) if small else out
    done, before, off = 0, None, float("inf")
    while off > TOLERANCE and (before is None or off < before * (1 - STALLED)):
        before = off if done else None
        more = rounds if not done else LOOK
        if small:
            out = raked_rounds(out, more)
            off = out.first()["off"]
            out = out.drop("off")
        else:
            for _ in range(more):
                for d in DIMENSIONS:
                    out = scaled(out, d)
            off = residual(out)
        done += more
    if off > TOLERANCE:
        warnings.warn(f"the targets contradict each other: after {done} rounds a category stays {off:.2g} from its target", stacklevel=2)
    if small:
        out = out.select(F.explode(F.arrays_zip("cells", "w")).alias("x")).select("x.cells.*", F.col("x.w").alias("fitted")).withColumn("weight", F.col("fitted"))
    return out.select(*DIMENSIONS, "tokens", "weight", F.lit(off).alias("residual"))


def probabilities(rows: DataFrame, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """source, lang, topic, documents, weight (wanted tokens per token, 1 on average), probability and residual of each cell of ``features``."""
    cells = cut(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents")))
    raked = rake(cells.drop("documents"), targets).withColumn("ratio", F.col("weight") / F.col("tokens"))
    most = raked.agg(F.max("ratio").alias("ratio"), F.sum("tokens").alias("tokens")).first()
    tokens, ratio = most["tokens"] or 0, most["ratio"] or 1.0
    whole = raked.select(*DIMENSIONS, (F.col("ratio") * F.lit(tokens)).alias("weight"), (F.col("ratio") / F.lit(ratio)).alias("probability"), "residual")
    return cut(cells.select(*DIMENSIONS, "documents").join(whole, list(DIMENSIONS)))


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from a document's id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / float(1 << 32)


def mixed(rows: DataFrame, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """The rows of ``features`` with weight, probability and selected."""
    key = F.struct(*DIMENSIONS)
    cells = probabilities(rows, targets).select(key.alias("cell"), "documents", "weight", "probability")
    joined = join_back(rows.withColumn("cell", key), cut(cells), "cell", "documents").drop("cell", "documents")
    return joined.withColumn("selected", draw(F.col("doc_id")) < F.coalesce("probability", F.lit(0.0)))


def sample(documents: DataFrame, targets: dict[str, DataFrame] | None = None, topic: str | None = None) -> DataFrame:
    """The documents drawn, with their own columns."""
    return mixed(features(documents, topic), targets).filter("selected").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    from .shared import table

    rows = cut(features(table(spark, sf_dir, "documents")).drop("row"))  # short rows: the texts are read once
    return mixed(rows).select("doc_id", "source", "lang", "topic", F.col("tokens").alias("n_tokens"), F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "selected")


def _oracle() -> str:
    steps, last = [], "f"
    for i in range(ROUNDS):
        for d in DIMENSIONS:
            steps.append(f"w{i}{d[0]} AS (SELECT * REPLACE (CASE WHEN sum(w) OVER (PARTITION BY {d}) > 0 THEN w * target_{d} / sum(w) OVER (PARTITION BY {d}) ELSE 0 END AS w) FROM {last})")
            last = f"w{i}{d[0]}"
    targets = ", ".join(f"t_{d} AS (SELECT {d}, t / sum(t) OVER () AS target_{d} FROM (SELECT {d}, pow(CAST(sum(tokens) AS DOUBLE), {TEMPER}) AS t FROM cells GROUP BY {d}))" for d in DIMENSIONS)
    return f"""
WITH x AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang FROM documents),
n AS (SELECT *, greatest(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 1) AS n_tokens FROM x),
d AS (SELECT doc_id, source, lang, n_tokens, CASE
    WHEN regexp_matches(text, '(?i){'|'.join(LICENCE)}') THEN 'licence'
    WHEN (length(text) - length(replace(text, '|', ''))) * 20 > n_tokens THEN 'table'
    WHEN regexp_matches(text, '{MAIL}|{PHONE}') THEN 'contact'
    WHEN n_tokens < 100 THEN 'note' ELSE 'prose' END AS topic FROM n),
cells AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY ALL),
{targets},
f AS (SELECT *, CAST(tokens AS DOUBLE) AS w FROM cells JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic)),
{', '.join(steps)},
m AS (SELECT source, lang, topic, w / tokens * sum(tokens) OVER () AS weight FROM {last}),
p AS (SELECT *, weight / max(weight) OVER () AS probability FROM m)
SELECT doc_id, source, lang, topic, CAST(n_tokens AS BIGINT) AS n_tokens, round(weight, 6) AS weight, round(probability, 6) AS probability,
       CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0 < probability AS selected
FROM d JOIN p USING (source, lang, topic)
"""


ORACLE = _oracle()
