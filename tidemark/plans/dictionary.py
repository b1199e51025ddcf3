"""Queries of terms that a table holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import vocabulary as V
from tidemark.operators import lexicon
from tidemark.plans.registry import query
from tidemark.sources import frames as S


def passage_terms(spark, d):
    """Words 1 and 2, 1 to 3, 2 to 5 and 4 of every benchmark passage."""
    w = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    cuts = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(n).alias("n")) for a, n in ((1, 2), (1, 3), (2, 4), (4, 1))))
    t = S.table(spark, d, "benchmark").select("item_id", w.alias("w"), F.explode(cuts).alias("c")).filter(F.size("w") >= 5)
    name = F.concat_ws("-", F.col("item_id"), F.col("c.a"), F.col("c.n"))
    return t.select(F.lit("passage").alias("kind"), F.array_join(F.slice("w", F.col("c.a"), F.col("c.n")), " ").alias("term"), name.alias("canonical"), F.lit(False).alias("cased"), F.lit(False).alias("closed"))


@query(
    "o038_dictionary_terms",
    r"""WITH RECURSIVE w AS (SELECT item_id, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM benchmark),
    t AS (SELECT lower(array_to_string(w[a:a + n - 1], ' ')) AS term, min(item_id || '-' || a || '-' || n) AS canonical FROM w, (VALUES (1, 2), (1, 3), (2, 4), (4, 1)) c(a, n) WHERE len(w) >= 5 GROUP BY 1),
    k AS (SELECT *, regexp_extract_all(term, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]') AS tp FROM t WHERE term <> ''),
    p AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]') AS p FROM documents WHERE text IS NOT NULL),
    u AS (SELECT doc_id, p, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM p),
    f AS (SELECT DISTINCT tp[1] AS first, len(tp) AS n FROM k),
    s AS (SELECT doc_id, i, n, lower(array_to_string(p[i:i + n - 1], '')) AS term FROM u JOIN f ON lower(x) = first
      WHERE i + n - 1 <= len(p) AND NOT regexp_matches(coalesce(p[i + n], ' '), '^[\p{L}\p{N}_]') AND (i = 1 OR NOT regexp_matches(p[i - 1], '^[\p{L}\p{N}_]'))),
    b AS (SELECT doc_id, i, max(n) AS n, arg_max(canonical, n) AS canonical FROM s JOIN k USING (term) GROUP BY ALL),
    r AS (SELECT DISTINCT doc_id, CAST(1 AS BIGINT) AS stop, CAST(NULL AS BIGINT) AS pos, '' AS canonical FROM b
      UNION ALL SELECT r.doc_id, min(b.i + b.n) FILTER (b.i = x.i), x.i, arg_min(b.canonical, b.i) FROM r JOIN LATERAL (SELECT min(i) AS i FROM b WHERE b.doc_id = r.doc_id AND b.i >= r.stop) x ON true JOIN b ON b.doc_id = r.doc_id AND b.i = x.i GROUP BY r.doc_id, x.i)
    SELECT doc_id, canonical, count(*) AS n, min(pos) - 1 AS first FROM r WHERE pos IS NOT NULL GROUP BY ALL""",
)
def dictionary_terms(spark, d):
    """How often each document has each term of the passages, and where first; overlapping terms settled."""
    met = lexicon.found_terms(S.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), passage_terms(spark, d))
    return met.groupBy(F.col("id").alias("doc_id"), "canonical").agg(F.count("*").alias("n"), F.min("start").cast("long").alias("first"))


FIELDS = {"techs": ["abbreviation", "technology"], "roles": ["role"], "companies": ["company"]}


def question_terms(spark, d):
    """The vocabulary's abbreviations and technologies, the roles it names, and the customers' names."""
    shape = "kind string, term string, canonical string, cased boolean, closed boolean"
    fixed = [("abbreviation", t, t, True, False) for t in V.CASED_ABBREVIATIONS] + [("technology", t, n, False, True) for t, n in V.TECH_TERMS.items()]
    fixed += [("role", r, r, False, True) for r in sorted({r for names in V.INTENT_ROLES.values() for r in names})]
    named = S.table(spark, d, "customer").select(F.lit("company").alias("kind"), F.col("c_name").alias("term"), F.col("c_name").alias("canonical"), F.lit(False).alias("cased"), F.lit(True).alias("closed"))
    return spark.createDataFrame(fixed, shape).unionByName(named)


@query("o042_dictionary_entities")
def dictionary_entities(spark, d):
    """Technologies, roles and companies of every turn of a conversation, by tables; what a question means where it names none."""
    turns = S.table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("id"), "text")
    out = lexicon.entities(turns, question_terms(spark, d), FIELDS, {"techs": V.INTENT_TECHS, "roles": V.INTENT_ROLES})
    return out.select("id.conv_id", "id.turn", *(F.array_join(f, ",").alias(f) for f in FIELDS))
