"""Scalar functions: Column in, Column out, all inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import vocabulary as V


def filled(*columns: Column) -> Column:
    """The first that is neither null nor an empty text."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def filled_array(*columns: Column) -> Column:
    """The first array with elements."""
    return F.coalesce(*(F.when(F.size(c) > 0, c) for c in columns))


def squeeze(text: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def fingerprint(title: Column, content: Column) -> Column:
    """md5 of the lower-cased, squeezed title and content."""
    return F.md5(squeeze(F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(content, F.lit(""))))).cast("binary"))


def full_fingerprint(title: Column, content: Column) -> Column:
    """``fingerprint`` with all of Unicode's white space squeezed and cut off at the ends."""
    whole = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(content, F.lit(""))))
    return F.md5(F.trim(F.regexp_replace(whole, r"(?U)[\s\x1C-\x1F]+", " ")).cast("binary"))


def url_id(url: Column) -> Column:
    return F.md5(url.cast("binary"))


def uuid_of(digest: Column) -> Column:
    """A 32-digit hexadecimal digest in UUID form."""
    return F.regexp_replace(digest, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def slug(name: Column) -> Column:
    """Lower-cased runs of a-z and 0-9 joined by hyphens; null if there are none."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(""))


def quality(title: Column, content: Column) -> Column:
    """0.3 for a title of 10 characters, 0.4 for a content of 200, 0.3 more for 800."""
    n = F.length(F.trim(F.coalesce(content, F.lit(""))))
    score = F.when(F.length(F.trim(F.coalesce(title, F.lit("")))) >= 10, 0.3).otherwise(0.0) + F.when(n >= 200, 0.4).otherwise(0.0) + F.when(n >= 800, 0.3).otherwise(0.0)
    return F.round(score, 2)


def blocked(title: Column, company: Column, description: Column) -> Column:
    """A page that a site served instead of a posting: no company, hardly a description, and a tell-tale or bare-domain title."""
    t = F.lower(F.trim(F.coalesce(title, F.lit(""))))
    mark = reduce(lambda a, b: a | b, [t.contains(m) for m in V.BLOCK_MARKS])
    bare = t.rlike(V.BARE_DOMAIN)
    return (F.trim(F.coalesce(company, F.lit(""))) == "") & (F.length(F.trim(F.coalesce(description, F.lit("")))) < 10) & (mark | bare)


def level(text: Column) -> Column:
    """The first level, from lead down to intern, one of whose words occurs in the text."""
    t = F.lower(F.coalesce(text, F.lit("")))
    out = None
    for name, words in V.LEVELS:
        hit = reduce(lambda a, b: a | b, [t.contains(w) for w in words])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def level_rank(name: Column) -> Column:
    return F.array_position(F.array(*(F.lit(x) for x in ("Intern", "Fresher", "Junior", "Middle", "Senior", "Lead"))), name)


def published_at(text: Column) -> Column:
    """A timestamp from the first 19 characters in one of four layouts, else null."""
    s = F.substring(text, 1, 19)
    return F.coalesce(*(F.try_to_timestamp(s, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy")))


def flexible_date(text: Column) -> Column:
    """ISO dates by their first ten characters; a/b/yyyy as day/month unless only month/day is possible; else null."""
    iso = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})", 1)
    part = lambda i: F.regexp_extract(text, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", i)
    a, b = part(1).try_cast("int"), part(2).try_cast("int")
    day, month = F.when((b > 12) & (a <= 12), b).otherwise(a), F.when((b > 12) & (a <= 12), a).otherwise(b)
    slashed = F.format_string("%s-%02d-%02d", part(3), month, day)
    return F.try_to_date(F.when(iso != "", iso).when(part(3) != "", slashed), "yyyy-MM-dd")


def month_of(day: Column) -> Column:
    return F.trunc(day, "month")


def month_index(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def period(name: Column, as_of: Column, days: int = 90) -> Column:
    """struct(first, last) of ``yyyy-Qn``, ``yyyy-mm`` or ``yyyy``; of null or an empty name the days up to as_of."""
    part = lambda pattern, i: F.regexp_extract(name, pattern, i)
    quarter, month = r"^(\d{4})-Q([1-4])$", r"^(\d{4})-(\d{2})$"
    begin = F.when(name.rlike(quarter), F.make_date(part(quarter, 1).try_cast("int"), part(quarter, 2).try_cast("int") * 3 - 2, F.lit(1)))
    begin = begin.when(name.rlike(month), F.try_to_date(F.concat(name, F.lit("-01")), "yyyy-MM-dd")).when(name.rlike(r"^\d{4}$"), F.try_to_date(F.concat(name, F.lit("-01-01")), "yyyy-MM-dd"))
    months = F.when(name.rlike(quarter), 3).when(name.rlike(month), 1).otherwise(12)
    none = F.coalesce(name, F.lit("")) == ""
    return F.struct(F.when(none, F.date_sub(as_of, days)).otherwise(begin).alias("first"), F.when(none, as_of).otherwise(F.date_sub(F.add_months(begin, months), 1)).alias("last"))


def locations(text: Column) -> Column:
    """Sorted places that a text names, by their names and short names."""
    return terms(text, {p.lower(): p for p in V.PLACES} | V.PLACE_ALIASES)


def hashed_words(text: Column, size: int) -> Column:
    """A vector of word counts by buckets of the words' md5."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    at = F.transform(words, lambda w: F.pmod(F.conv(F.substring(F.md5(w.cast("binary")), 1, 4), 16, 10).cast("int"), F.lit(size)))
    # One pass: an expression inside a lambda would be computed again for each bucket.
    return F.aggregate(at, F.array_repeat(F.lit(0), size), lambda counts, x: F.transform(counts, lambda n, i: n + (i == x).cast("int")))


def growth(now: Column, before: Column) -> Column:
    """Percent, two places; 0 without a value before."""
    return F.when(F.coalesce(before, F.lit(0)) == 0, 0.0).otherwise(F.round((now - before) / F.nullif(before, F.lit(0)) * 100.0, 2))


def salary(text: Column) -> Column:
    """struct(low, high, mid) in million VND, null if it says none.

    Ranges ``a - b`` in either order, ``above a`` (a to 2a) and ``up to b`` (b/2 to b).
    Commas and dots are thousands marks.  Dollars count 0.025; other numbers over 1000
    without a word for millions are thousands.  Kept from 1 to 500."""
    t = F.coalesce(text, F.lit(""))
    number = r"(\d[\d,.]*)"
    value = lambda pattern, i: F.regexp_replace(F.regexp_extract(t, pattern, i), "[.,]", "").try_cast("double")
    span, above, upto = r"\$?\s*" + number + r"\s*[-–—~]\s*\$?\s*" + number, f"(?iu)({V.ABOVE})\\s+{number}", f"(?iu)({V.UP_TO})\\s+{number}"
    a, b = value(span, 1), value(span, 2)
    over, under = value(above, 2), value(upto, 2)
    low = F.when(a.isNotNull(), F.least(a, b)).when(over.isNotNull(), over).otherwise(under / 2)
    high = F.when(a.isNotNull(), F.greatest(a, b)).when(over.isNotNull(), over * 2).otherwise(under)
    millions = reduce(lambda x, y: x | y, [F.lower(t).contains(w) for w in V.MILLIONS])
    unit = lambda x: F.when(t.rlike(V.DOLLARS), x * V.USD_TO_MILLION_VND).when(~millions & (x > 1000), x / 1000).otherwise(x)
    low, high = unit(low), unit(high)
    return F.when(~t.rlike(V.NEGOTIABLE) & (low >= 1) & (high <= 500), F.struct(low.alias("low"), high.alias("high"), ((low + high) / 2).alias("mid")))


def terms(text: Column, names: dict[str, str]) -> Column:
    """Sorted distinct values of ``names`` whose key occurs in the text as a whole term, in any case; the longest key wins."""
    keys = sorted((k.lower() for k in names), key=lambda k: (-len(k), k))
    quote = lambda k: "".join("\\" + c if not (c.isalnum() or c.isspace()) else c for c in k)
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?iU)(?<!\w)(" + "|".join(map(quote, keys)) + r")(?!\w)"), 1)
    lookup = F.create_map(*(F.lit(x) for k, v in names.items() for x in (k.lower(), v)))
    return F.sort_array(F.array_distinct(F.transform(found, lambda x: lookup[x])))


def canonical(names: Column, aliases: Column) -> Column:
    """Names through a lower-cased alias map, in order, without blanks and repeats."""
    one = lambda x: F.coalesce(aliases[F.lower(F.trim(x))], F.trim(x))
    return F.array_distinct(F.filter(F.transform(names, one), lambda x: x != ""))


def tech_key(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), r"[\s._/-]+", " "))


def company_core(name: Column) -> Column:
    """A company's name without legal forms and punctuation, lower-cased; null if shorter than 6 or the name is longer than 200."""
    bare = F.regexp_replace(F.lower(name), "(?iU)" + "|".join(V.LEGAL_FORMS), " ")
    core = squeeze(F.regexp_replace(bare, r"[^\p{L}\p{N}]+", " "))
    return F.when((F.length(name) <= 200) & (F.length(core) >= 6), core)


def strip_html(html: Column) -> Column:
    return squeeze(F.regexp_replace(html, "<[^>]+>", " "))


def passage(title: Column, content: Column, most: int = 1000) -> Column:
    return F.substring(F.trim(F.concat_ws(" ", title, content)), 1, most)


def expand_acronym(name: Column, long_forms: dict[str, str]) -> Column:
    lookup = F.create_map(*(F.lit(x) for kv in long_forms.items() for x in kv))
    return F.coalesce(F.concat(name, F.lit(" ("), lookup[name], F.lit(")")), name)


def llm_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Prices are per million tokens; an unknown price costs nothing."""
    cost = tokens_in / 1e6 * F.coalesce(price_in, F.lit(0.0)) + tokens_out / 1e6 * F.coalesce(price_out, F.lit(0.0))
    return cost.cast("decimal(12,6)")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def overlap_share(answer: Column, context: Column) -> Column:
    """Share of an answer's distinct words that the context has."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != ""))
    return F.try_divide(F.size(F.array_intersect(words(answer), words(context))), F.size(words(answer)))


def name_ratio(a: Column, b: Column) -> Column:
    """1 minus the edit distance over the longer length."""
    return 1 - F.try_divide(F.levenshtein(a, b).cast("double"), F.greatest(F.length(a), F.length(b)))
