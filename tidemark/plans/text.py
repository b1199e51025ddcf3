"""Queries over documents, pages and conversations: cleaning, normalising, extraction, audits."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions.vocabulary import TECH_TERMS
from tidemark.operators import serving
from tidemark.operators.names import nearest_names
from tidemark.plans.registry import query
from tidemark.sources import frames as S

WORDS = {"the": "The", "of": "Of", "der": "Der", "les": "Les", "una": "Una", "license": "License"}
NORM = r"trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g'))"


@query("o023_quality_score", "SELECT doc_id, round((CASE WHEN length(trim(source)) >= 4 THEN 0.3 ELSE 0.0 END) + 0.0, 2) AS title_part, round(CASE WHEN length(trim(text)) >= 200 THEN 0.4 ELSE 0.0 END + CASE WHEN length(trim(text)) >= 800 THEN 0.3 ELSE 0.0 END + CASE WHEN length(trim(source || '-title-long')) >= 10 THEN 0.3 ELSE 0.0 END, 2) AS quality FROM documents")
def quality(spark, d):
    t = S.table(spark, d, "documents")
    return t.select("doc_id", F.when(F.length(F.trim("source")) >= 4, 0.3).otherwise(0.0).alias("title_part"), C.quality(F.concat("source", F.lit("-title-long")), F.col("text")).alias("quality"))


@query("o022_blocked_pages", "SELECT count(*) AS pages, CAST(sum(CASE WHEN regexp_matches(lower(trim(url)), 'blocked|captcha|access denied|cloudflare') OR regexp_matches(lower(trim(url)), '^(www\\.)?[a-z0-9-]+\\.(vn|com|net|org)$') THEN 1 ELSE 0 END) AS BIGINT) AS blocked FROM pages")
def blocked(spark, d):
    b = C.blocked(F.col("url"), F.lit(""), F.lit(""))
    return S.table(spark, d, "pages").agg(F.count("*").alias("pages"), F.sum(b.cast("long")).alias("blocked"))


@query(
    "o022_blocked_rows",
    """WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN ' Access Denied ' WHEN 1 THEN 'site' || page_id || '.com' WHEN 2 THEN 'CAPTCHA please' ELSE 'Backend developer' END AS title,
  CASE WHEN page_id % 3 = 0 THEN 'ACME' WHEN page_id % 3 = 1 THEN ' ' END AS company, substr(html, 1, CAST(page_id % 5 AS INT) * 4) AS description FROM pages)
SELECT page_id, trim(coalesce(company, '')) = '' AND length(trim(description)) < 10
  AND (regexp_matches(lower(trim(title)), 'blocked|captcha|access denied|cloudflare') OR regexp_matches(lower(trim(title)), '^(www\\.)?[a-z0-9-]+\\.(vn|com|net|org)$')) AS blocked FROM p""",
)
def blocked_rows(spark, d):
    """Pages with titles, companies and descriptions of both kinds."""
    n = F.col("page_id")
    title = F.when(n % 4 == 0, " Access Denied ").when(n % 4 == 1, F.concat(F.lit("site"), n, F.lit(".com"))).when(n % 4 == 2, "CAPTCHA please").otherwise("Backend developer")
    company = F.when(n % 3 == 0, "ACME").when(n % 3 == 1, " ")
    description = F.substring("html", F.lit(1), (n % 5 * 4).cast("int"))
    return S.table(spark, d, "pages").select("page_id", C.blocked(title, company, description).alias("blocked"))


SPACE = r"[\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query("o031_content_hash", f"SELECT doc_id, md5(trim(regexp_replace(lower(coalesce(text, '')), '{SPACE}', ' ', 'g'))) AS h FROM documents")
def content_hash(spark, d):
    """The hash of every text, null as empty."""
    return S.table(spark, d, "documents").select("doc_id", C.full_fingerprint(F.lit(""), F.col("text")).alias("h"))


@query("o101_content_dedup", f"WITH h AS (SELECT doc_id, md5({NORM}) AS h FROM documents), f AS (SELECT *, min(doc_id) OVER (PARTITION BY h) AS f FROM h) SELECT doc_id, doc_id <> f AS is_duplicate, CASE WHEN doc_id <> f THEN f END AS duplicate_of FROM f")
def content_dedup(spark, d):
    rows = S.table(spark, d, "documents").select("doc_id", C.fingerprint(F.lit(""), F.col("text")).alias("h"))
    first = rows.groupBy("h").agg(F.min("doc_id").alias("f"), F.count("*").alias("n")).filter("n > 1")
    out = rows.join(first, "h", "left").withColumn("f", F.coalesce("f", "doc_id"))
    return out.select("doc_id", (F.col("doc_id") != F.col("f")).alias("is_duplicate"), F.when(F.col("doc_id") != F.col("f"), F.col("f")).alias("duplicate_of"))


@query("o038_keyword_extract", "WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM documents), k AS (SELECT doc_id, unnest(w) AS w FROM w) SELECT doc_id, string_agg(v, ',' ORDER BY v) AS found FROM k JOIN (VALUES ('the', 'The'), ('of', 'Of'), ('der', 'Der'), ('les', 'Les'), ('una', 'Una'), ('license', 'License')) t(w, v) USING (w) GROUP BY 1")
def keywords(spark, d):
    t = S.table(spark, d, "documents").select("doc_id", C.terms(F.col("text"), WORDS).alias("f"))
    return t.filter(F.size("f") > 0).select("doc_id", F.array_join("f", ",").alias("found"))


@query("o041_token_extraction", "SELECT doc_id, len(regexp_extract_all(text, '[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}')) AS addresses, len(regexp_extract_all(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+')) AS mails FROM documents")
def tokens(spark, d):
    count = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return S.table(spark, d, "documents").select("doc_id", count(r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}").alias("addresses"), count(r"[A-Za-z0-9._]+@[A-Za-z0-9.]+").alias("mails"))


@query("o043_intents", "SELECT item_id, regexp_matches(lower(text), 'trend|growth|compare|top') AS analytics, regexp_matches(lower(text), 'related|path|between') AS multi_hop FROM benchmark")
def intents(spark, d):
    t = F.lower("text")
    return S.table(spark, d, "benchmark").select("item_id", t.rlike("trend|growth|compare|top").alias("analytics"), t.rlike("related|path|between").alias("multi_hop"))


@query(
    "o043_part_intents",
    """WITH q AS (SELECT p_partkey AS id, p_name || CASE p_partkey % 4 WHEN 0 THEN ' Growth' WHEN 1 THEN ' RELATED to' WHEN 2 THEN ' compare the path' ELSE '' END AS text FROM part)
SELECT id, regexp_matches(lower(text), 'trend|growth|compare|top') AS analytics, regexp_matches(lower(text), 'related|path|between') AS multi_hop FROM q""",
)
def part_intents(spark, d):
    n = F.col("p_partkey")
    t = F.lower(F.concat("p_name", F.when(n % 4 == 0, " Growth").when(n % 4 == 1, " RELATED to").when(n % 4 == 2, " compare the path").otherwise("")))
    return S.table(spark, d, "part").select(n.alias("id"), t.rlike("trend|growth|compare|top").alias("analytics"), t.rlike("related|path|between").alias("multi_hop"))


@query("o052_html_strip", r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS body FROM pages")
def html(spark, d):
    return S.table(spark, d, "pages").select("page_id", C.strip_html(F.col("html")).alias("body"))


@query("o053_passage", "SELECT doc_id, substring(trim(source || ' ' || text), 1, 600) AS passage FROM documents")
def passages(spark, d):
    return S.table(spark, d, "documents").select("doc_id", C.passage(F.col("source"), F.col("text"), 600).alias("passage"))


@query("o037_slug", "SELECT c_custkey, nullif(regexp_replace(regexp_replace(lower(trim(c_name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), '') AS slug FROM customer")
def slugs(spark, d):
    return S.table(spark, d, "customer").select("c_custkey", C.slug(F.col("c_name")).alias("slug"))


@query("o045_tech_key", r"SELECT p_partkey, trim(regexp_replace(lower(p_name), '[\s._/-]+', ' ', 'g')) AS key FROM part")
def keys(spark, d):
    return S.table(spark, d, "part").select("p_partkey", C.tech_key(F.col("p_name")).alias("key"))


@query("o141_url_identity", r"SELECT page_id, md5(url) AS id, regexp_replace(md5(url), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5') AS uuid FROM pages")
def identity(spark, d):
    return S.table(spark, d, "pages").select("page_id", C.url_id(F.col("url")).alias("id"), C.uuid_of(C.url_id(F.col("url"))).alias("uuid"))


@query("o033_flexible_date", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS iso, CASE WHEN day(o_orderdate) > 12 OR month(o_orderdate) <= 12 THEN CAST(o_orderdate AS DATE) END AS slashed FROM orders")
def flexible(spark, d):
    t = S.table(spark, d, "orders")
    return t.select("o_orderkey", C.flexible_date(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("iso"), C.flexible_date(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("slashed"))


@query("o032_published_at", "SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS at FROM orders")
def published(spark, d):
    return S.table(spark, d, "orders").select("o_orderkey", C.published_at(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz").alias("at"))


@query("o036_levels", "SELECT o_orderpriority AS raw, count(*) AS jobs, CASE o_orderpriority WHEN '1-URGENT' THEN 'Lead' WHEN '2-HIGH' THEN 'Senior' ELSE 'Intern' END AS level FROM orders GROUP BY 1")
def levels(spark, d):
    text = F.when(F.col("o_orderpriority") == "1-URGENT", "Senior Team Lead").when(F.col("o_orderpriority") == "2-HIGH", "Chuyên gia").otherwise("International")
    return S.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("raw")).agg(F.count("*").alias("jobs"), F.first(C.level(text)).alias("level"))


@query("o046_salary_parser", "SELECT p_partkey, CASE WHEN p_size * 40 * 0.025 >= 1 AND p_size * 80 * 0.025 <= 500 THEN round((p_size * 40 * 0.025 + p_size * 80 * 0.025) / 2, 3) END AS mid FROM part")
def salaries(spark, d):
    text = F.format_string("$%,d - $%,d", F.col("p_size") * 80, F.col("p_size") * 40)
    return S.table(spark, d, "part").select("p_partkey", F.round(C.salary(text)["mid"], 3).alias("mid"))


@query("o044_alias_canonical", "SELECT doc_id, CASE lower(lang) WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' ELSE lang END || ',' || source AS names FROM documents")
def aliases(spark, d):
    known = F.create_map(F.lit("en"), F.lit("English"), F.lit("de"), F.lit("German"))
    return S.table(spark, d, "documents").select("doc_id", F.array_join(C.canonical(F.array(F.concat(F.lit(" "), "lang"), F.lit(""), "source", "source"), known), ",").alias("names"))


@query(
    "o108_term_union",
    r"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter([
    CASE WHEN regexp_matches(lower(coalesce(text, '')), '(^|[^\p{L}\p{M}\p{N}_])the($|[^\p{L}\p{M}\p{N}_])') THEN 'The' END, lang], lambda x: x IS NOT NULL))), ',') AS terms FROM documents""",
)
def union_terms(spark, d):
    """Terms of every text, with any given one."""
    found = F.array_union(C.terms(F.col("text"), {"the": "The"}), F.array_compact(F.array("lang")))
    return S.table(spark, d, "documents").select("doc_id", F.array_join(F.sort_array(found), ",").alias("terms"))


@query("o110_array_sets", "WITH t AS (SELECT conv_id, list_sort(list_distinct(list(role))) AS roles FROM conversations GROUP BY 1) SELECT conv_id, array_to_string(list_sort(list_filter(roles, lambda x: x <> 'user')), ',') AS others, list_contains(roles, 'user') AS has_user FROM t")
def array_sets(spark, d):
    t = S.table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_set("role")).alias("roles"))
    return t.select("conv_id", F.array_join(F.array_except("roles", F.array(F.lit("user"))), ",").alias("others"), F.array_contains("roles", "user").alias("has_user"))


@query("o028_array_predicates", "WITH t AS (SELECT source, list(DISTINCT lang) AS langs FROM documents GROUP BY 1) SELECT source, list_contains(langs, 'de') AS has_de, len(list_intersect(langs, ['fr', 'es'])) > 0 AS romance FROM t")
def array_predicates(spark, d):
    t = S.table(spark, d, "documents").groupBy("source").agg(F.collect_set("lang").alias("langs"))
    return t.select("source", F.array_contains("langs", "de").alias("has_de"), F.arrays_overlap("langs", F.array(F.lit("fr"), F.lit("es"))).alias("romance"))


@query(
    "o028_job_arrays",
    """WITH t AS (SELECT l_orderkey AS job, list(DISTINCT p_name) AS techs FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1), n AS (SELECT min(p_name) AS low, max(p_name) AS high FROM part)
SELECT job, list_contains(techs, low) AS has_low, len(list_intersect(techs, [low, high])) > 0 AS has_any, len(list_intersect(techs, [low, high])) = 2 AS has_both FROM t, n""",
)
def job_arrays(spark, d):
    ends = S.table(spark, d, "part").agg(F.min("p_name").alias("low"), F.max("p_name").alias("high"))
    techs = S.requires(spark, d).groupBy("job").agg(F.collect_set("tech").alias("techs")).crossJoin(F.broadcast(ends))
    wanted = F.array("low", "high")
    return techs.select("job", F.array_contains("techs", F.col("low")).alias("has_low"), F.arrays_overlap("techs", wanted).alias("has_any"), (F.size(F.array_except(wanted, F.col("techs"))) == 0).alias("has_both"))


@query("o025_substring_search", r"SELECT doc_id FROM documents WHERE text ILIKE '%license%' OR text ILIKE '%100\%%' ESCAPE '\'")
def substring(spark, d):
    return S.table(spark, d, "documents").filter(F.lower("text").contains("license") | F.col("text").ilike(r"%100\%%")).select("doc_id")


@query("o184_name_search", "SELECT c_custkey, split_part(c_name, chr(10), 1) AS name FROM customer WHERE lower(c_name) LIKE '%0000001%' ORDER BY name, c_custkey LIMIT 20 OFFSET 5")
def names(spark, d):
    t = S.table(spark, d, "customer").filter(F.lower("c_name").contains("0000001"))
    return t.select("c_custkey", F.split_part("c_name", F.lit("\n"), F.lit(1)).alias("name")).orderBy("name", "c_custkey").offset(5).limit(20)


@query("o146_faithfulness", r"WITH a AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS w FROM conversations), p AS (SELECT x.conv_id, x.turn, len(list_intersect(x.w, y.w)) / CAST(len(x.w) AS DOUBLE) AS s FROM a x JOIN a y ON x.conv_id = y.conv_id AND y.turn = x.turn - 1 WHERE len(x.w) > 0) SELECT conv_id, turn, round(s, 4) AS overlap FROM p")
def faithfulness(spark, d):
    t = S.table(spark, d, "conversations")
    before = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("context"))
    return t.join(before, ["conv_id", "turn"]).select("conv_id", "turn", F.round(C.overlap_share(F.col("text"), F.col("context")), 4).alias("overlap")).filter("overlap IS NOT NULL")


@query("o147_fuzzy_name", "WITH n AS (SELECT DISTINCT p_name AS name FROM part), q AS (SELECT name || 'x' AS q FROM n), s AS (SELECT q, name, 1 - levenshtein(q, name) / CAST(greatest(length(q), length(name)) AS DOUBLE) AS s FROM q, n), k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, name) AS rn FROM s WHERE s >= 0.6) SELECT q, name, round(s, 4) AS ratio FROM k WHERE rn = 1")
def fuzzy(spark, d):
    n = S.table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    q = n.select(F.concat("name", F.lit("x")).alias("q"))
    return nearest_names(q, n, 0.6).select("q", "name", F.round("s", 4).alias("ratio"))


@query("o047_company_core", r"SELECT s_suppkey, CASE WHEN length(trim(regexp_replace(lower(s_name), '[^\p{L}\p{N}]+', ' ', 'g'))) >= 6 THEN trim(regexp_replace(lower(s_name), '[^\p{L}\p{N}]+', ' ', 'g')) END AS core FROM supplier")
def cores(spark, d):
    return S.table(spark, d, "supplier").select("s_suppkey", C.company_core(F.concat(F.lit("Công ty TNHH "), "s_name", F.lit(" Co., Ltd."))).alias("core"))


@query("o048_acronym", "SELECT DISTINCT lang, CASE lang WHEN 'en' THEN 'en (English)' ELSE lang END AS name FROM documents")
def acronym(spark, d):
    return S.table(spark, d, "documents").select("lang").distinct().select("lang", C.expand_acronym(F.col("lang"), {"en": "English"}).alias("name"))


# No key is a whole term within another one, so each can be looked for on its own.
TERM_ROWS = ", ".join(f"('{re.escape(k)}', '{v}')" for k, v in TECH_TERMS.items())


@query(
    "o042_query_entities",
    rf"""WITH k(k, v) AS (VALUES {TERM_ROWS}),
    f AS (SELECT DISTINCT item_id, v FROM benchmark, k WHERE regexp_matches(lower(text), '(^|[^\p{{L}}\p{{M}}\p{{N}}_])' || k || '($|[^\p{{L}}\p{{M}}\p{{N}}_])'))
    SELECT item_id, coalesce(string_agg(v, ',' ORDER BY v), '') AS found, CAST(count(v) AS INTEGER) AS n FROM benchmark LEFT JOIN f USING (item_id) GROUP BY 1""",
)
def entities(spark, d):
    """The terms of every text and their number."""
    found = S.table(spark, d, "benchmark").select("item_id", C.terms(F.col("text"), TECH_TERMS).alias("f"))
    return found.select("item_id", F.array_join("f", ",").alias("found"), F.size("f").alias("n"))


@query("o185_threshold_sweep", "WITH s AS (SELECT doc_id, least(n_chars / 3000.0, 1.0) AS score, quality AS label FROM documents JOIN labels USING (doc_id)), l AS (SELECT i / 10.0 AS lim FROM range(0, 11) t(i)), g AS (SELECT lim, CAST(sum(CASE WHEN score >= lim AND label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN score >= lim AND label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN score < lim AND label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn, CAST(sum(CASE WHEN score < lim AND label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn FROM s, l GROUP BY 1) SELECT round(CAST(lim AS DOUBLE), 1) AS \"limit\", tp, fp, tn, fn, round((tp + tn) / CAST(tp + fp + tn + fn AS DOUBLE), 4) AS accuracy, CASE WHEN tp + fp = 0 THEN 0.0 ELSE round(tp / CAST(tp + fp AS DOUBLE), 4) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE round(tp / CAST(tp + fn AS DOUBLE), 4) END AS recall, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 4) END AS f1 FROM g")
def sweep(spark, d):
    rows = S.table(spark, d, "documents").join(S.table(spark, d, "labels"), "doc_id").select(F.least(F.col("n_chars") / 3000.0, F.lit(1.0)).alias("score"), F.col("quality").alias("label"))
    limits = S.series(spark, 0, 10, "i").select(F.round(F.col("i") / 10.0, 1).alias("limit"))
    return serving.binary_metrics(rows, limits)


@query("o093_coverage_by_platform", "SELECT coalesce(source, 'unknown') AS platform, count(*) AS total, count(quality) AS with_label, round(count(quality) * 100.0 / count(*), 1) AS pct FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def coverage_by_platform(spark, d):
    t = S.table(spark, d, "documents").join(S.table(spark, d, "labels"), "doc_id", "left").groupBy(F.coalesce("source", F.lit("unknown")).alias("platform"))
    return t.agg(F.count("*").alias("total"), F.count("quality").alias("with_label")).withColumn("pct", F.round(F.col("with_label") * 100.0 / F.col("total"), 1))


@query("o021_envelope_flatten", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE lang END AS title FROM documents")
def flatten(spark, d):
    data = F.struct(F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("").alias("title"), F.col("lang").alias("job_title"))
    return S.table(spark, d, "documents").withColumn("data", data).select("doc_id", C.filled(F.col("data.title"), F.col("data.job_title")).alias("title"))
