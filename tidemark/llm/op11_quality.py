"""Quality rules, line first, in DataFrame functions only.

Each line of a text is judged by three rules: it must end like a sentence (punctuation),
must not be a short line of links (navigation), and must not be a stock phrase of sites and
licences (boilerplate).  Lines that fail a rule are removed; a document that loses more than
MAX_LOSS of its word characters that way is rejected.  Before that, the base rules reject
documents of few words and those that repeat themselves.

Everything about a document is worked out in its own row, so texts never move: there is no
shuffle.  Repeated windows are found by sorting hashes of a text's windows; those with a neighbour
of equal hash are sorted again by their words, so the counts are exact; all in time n log n
of a text's words.

Defined cases: a null, empty or blank text has no words and fails the base rules; a line
without a word is neither judged nor counted; lines are equal if all their characters are;
a very long text or line is judged whole; equal texts have equal results, also of rows that
repeat a doc_id or have none; an empty table gives no rows; other columns don't matter,
whatever their names, and ``clean`` keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space and symbols of the contract, and its limits.
SPACE, NOT_BLANK = "[\\x20\\x09-\\x0D]+", "[^\\x20\\x09-\\x0D]"
SYMBOLS = "[#*$%&|<>]"
LEAST_WORDS, MOST_REPEATED = 50, 50

# Rules of a line.  No pattern begins with a run, so each is one pass.
SENTENCE_END = "[.!?…。！？][\"'”’»)\\]]*[\\x20\\x09-\\x0D]*$"
LINKS = "read more|click here|sign in|log in|log out|skip to content|back to top|share this|next page|previous page|site ?map|main menu"
BARS = "[|»›·•]"
NAVIGATION_WORDS, NAVIGATION_BARS = 12, 3
STOCK = "all rights reserved|privacy policy|cookie policy|use of cookies|terms of (use|service)|javascript|lorem ipsum|licensed under|copyright|permission is hereby granted"
MAX_LOSS = 30  # of 100 word characters
PLACE_BITS = 31


def without(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(""))


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def candidates(listed: Column) -> Column:
    """Sorted numbers of the windows of three words: 33 bits of a hash, then 31 of the place.  Equal windows are neighbours, or have only windows of equal hash between."""
    firsts = F.slice(listed, F.lit(1), F.greatest(F.size(listed) - 2, F.lit(0)))
    number = lambda w, i: F.shiftleft(F.xxhash64(w, F.get(listed, i + 1), F.get(listed, i + 2)), PLACE_BITS).bitwiseOR(i.cast("long"))
    return F.sort_array(F.transform(firsts, number))


def among_equals(numbers: Column) -> Column:
    """Places of the windows that have a neighbour of equal hash."""
    own = lambda x: F.shiftright(x, PLACE_BITS)
    near = F.filter(numbers, lambda x, i: (own(x) == own(F.get(numbers, i - 1))) | (own(x) == own(F.get(numbers, i + 1))))
    return F.transform(near, lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int"))


def windows(listed: Column, places: Column) -> Column:
    """The windows at ``places``, sorted by their words."""
    at = lambda i, k: F.get(listed, i + k)
    return F.sort_array(F.transform(places, lambda i: F.struct(F.struct(at(i, 0).alias("a"), at(i, 1).alias("b"), at(i, 2).alias("c")).alias("words"), i.alias("at"))))


def repeated_starts(sorted_windows: Column) -> Column:
    """Where windows found twice or more begin, ascending."""

    def twice(window: Column, i: Column) -> Column:
        before, after = F.get(sorted_windows, i - 1), F.get(sorted_windows, i + 1)
        return (window["words"] == before["words"]) | (window["words"] == after["words"])

    return F.sort_array(F.transform(F.filter(sorted_windows, twice), lambda x: x["at"]))


def covered(starts: Column) -> Column:
    """Words that lie in the windows that begin at ``starts``, each counted once."""
    own = F.transform(starts, lambda at, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - at, F.lit(3))))
    return F.aggregate(own, F.lit(0).cast("long"), lambda n, x: n + x)


def verdicts(line: Column) -> Column:
    """unfinished, navigation, boilerplate: the rules that a line fails."""
    few = F.size(F.split(line, SPACE, NAVIGATION_WORDS + 2)) <= NAVIGATION_WORDS
    links = (F.size(F.split(line, BARS, NAVIGATION_BARS + 1)) > NAVIGATION_BARS) | (F.rlike(line, F.lit(f"(?i)({LINKS})")) & few)
    return F.struct((~F.rlike(line, F.lit(SENTENCE_END))).alias("unfinished"), links.alias("navigation"), F.rlike(line, F.lit(f"(?i)({STOCK})")).alias("boilerplate"))


def judged(documents: DataFrame) -> DataFrame:
    """row (the document's own columns), doc_id, the counts of the base rules, lines and failures by rule, kept_chars, base_failed, kept, cleaned (the lines that stay)."""
    # Each array is a column before a lambda looks into it: an expression would be worked out once for each element.
    rows = documents.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"))
    rows = rows.select("*", words(F.col("body")).alias("listed"), F.filter(F.split("body", "\n"), lambda x: F.rlike(x, F.lit(NOT_BLANK))).alias("lines"))
    rows = rows.select("*", candidates(F.col("listed")).alias("numbers"), F.transform("lines", verdicts).alias("failed"))
    rows = rows.select("*", among_equals(F.col("numbers")).alias("places")).drop("numbers")
    rows = rows.select("*", windows(F.col("listed"), F.col("places")).alias("windows")).drop("places")
    rows = rows.select("*", repeated_starts(F.col("windows")).alias("starts")).drop("windows")
    passes = lambda x, i: ~(F.get("failed", i)["unfinished"] | F.get("failed", i)["navigation"] | F.get("failed", i)["boilerplate"])
    rows = rows.select("*", F.array_join(F.filter("lines", passes), "\n").alias("cleaned"))
    count = lambda rule: F.size(F.filter("failed", lambda x: x[rule])).cast("long").alias(f"n_{rule}")
    rows = rows.select(
        "row", "doc_id", "cleaned",
        F.size("listed").cast("long").alias("n_words"),
        F.length(F.array_join("listed", "")).cast("long").alias("word_chars"),
        (F.length("body") - F.length(without(F.col("body"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered(F.col("starts")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        count("unfinished"), count("navigation"), count("boilerplate"),
        F.length(without(F.col("cleaned"), SPACE)).cast("long").alias("kept_chars"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    whole = 100 * F.col("kept_chars") >= (100 - MAX_LOSS) * F.col("word_chars")
    return rows.select("*", failed.alias("base_failed"), (~failed & whole).alias("kept"))


def clean(documents: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; text holds the lines that stay."""
    kept = judged(documents).filter("kept").select("row", "cleaned")
    return kept.select(*(F.col("cleaned").alias("text") if c.lower() == "text" else F.col("row")[c].alias(c) for c in documents.columns))


def query(spark, sf_dir: str) -> DataFrame:
    from .shared import table

    return judged(table(spark, sf_dir, "documents")).drop("row", "cleaned")


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body FROM documents),
w AS (SELECT r, regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
g AS (SELECT r, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT r, unnest(list(i)) AS i FROM g GROUP BY r, a, b, c HAVING count(*) > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
l AS (SELECT r, line, length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g')) AS chars FROM (SELECT r, unnest(string_split(body, chr(10))) AS line FROM d)),
v AS (SELECT r, line, chars, NOT regexp_matches(line, '{SENTENCE_END.replace("'", "''")}') AS u,
    len(string_split_regex(line, '{BARS}')) > {NAVIGATION_BARS}
      OR (len(string_split_regex(line, '[\\x20\\x09-\\x0D]+')) <= {NAVIGATION_WORDS} AND regexp_matches(line, '(?i)({LINKS})')) AS n,
    regexp_matches(line, '(?i)({STOCK})') AS b FROM l WHERE chars > 0),
s AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup, count(*) FILTER (u) AS u, count(*) FILTER (n) AS n, count(*) FILTER (b) AS b,
    CAST(sum(chars) FILTER (NOT u AND NOT n AND NOT b) AS BIGINT) AS kept_chars FROM v GROUP BY r),
j AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, length(regexp_replace(body, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
    length(body) - length(regexp_replace(body, '{SYMBOLS}', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, coalesce(u, 0) AS n_unfinished, coalesce(s.n, 0) AS n_navigation, coalesce(b, 0) AS n_boilerplate, coalesce(kept_chars, 0) AS kept_chars
  FROM d JOIN w USING (r) LEFT JOIN covered USING (r) LEFT JOIN s USING (r))
SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
  NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AND 100 * kept_chars >= {100 - MAX_LOSS} * word_chars AS kept
FROM j
"""
