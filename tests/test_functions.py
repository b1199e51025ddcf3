"""Scalar functions against literal values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as C


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("title,content,want", [("", "", 0.0), ("a" * 13, "", 0.3), ("a" * 13, "b" * 200, 0.7), ("a" * 13, "b" * 800, 1.0), ("short", "b" * 800, 0.7)])
def test_quality(spark, title, content, want):
    assert value(spark, C.quality(F.lit(title), F.lit(content))) == want


@pytest.mark.parametrize(
    "text,want",
    [("29/06/2026", dt.date(2026, 6, 29)), ("06/30/2026", dt.date(2026, 6, 30)), ("05/06/2026", dt.date(2026, 6, 5)), ("13/13/2026", None), ("2026-02-30", None), ("June 30, 2026", None), ("2026-06-30T10:15:00Z", dt.date(2026, 6, 30))],
)
def test_flexible_date(spark, text, want):
    assert value(spark, C.flexible_date(F.lit(text))) == want


@pytest.mark.parametrize(
    "text,want",
    [("10 - 20 triệu", (10, 20)), ("1000 - 2000 USD", (25, 50)), ("$1,500 - $3,000", (37.5, 75)), ("1,200 - 2,000 USD", (30, 50)), ("Trên 15 triệu", (15, 30)), ("Thỏa thuận", None), ("Negotiable", None), ("20-10 triệu", (10, 20)), ("up to 30 triệu", (15, 30)), (None, None)],
)
def test_salary(spark, text, want):
    got = value(spark, C.salary(F.lit(text)))
    assert (got and (got["low"], got["high"])) == want


@pytest.mark.parametrize("text,want", [("Senior Team Lead", "Lead"), ("International", "Intern"), ("nhân viên", "Junior"), ("mid-level", "Middle"), ("", None), (None, None)])
def test_level(spark, text, want):
    assert value(spark, C.level(F.lit(text))) == want


def test_growth(spark):
    assert value(spark, C.growth(F.lit(15), F.lit(10))) == 50.0
    assert value(spark, C.growth(F.lit(15), F.lit(0))) == 0.0
    assert value(spark, C.growth(F.lit(15), F.lit(None).cast("int"))) == 0.0


def test_terms_need_whole_words_and_prefer_long_ones(spark):
    text = F.lit("JavaScript and Spring boot, not javac; HỌC MÁY with C++.")
    assert value(spark, C.terms(text, {"java": "Java", "javascript": "JavaScript", "spring boot": "Spring Boot", "spring": "Spring", "học máy": "ML", "c++": "C++"})) == ["C++", "JavaScript", "ML", "Spring Boot"]


def test_slug_and_core(spark):
    assert value(spark, C.slug(F.lit("  FPT Software, Ltd. "))) == "fpt-software-ltd"
    assert value(spark, C.slug(F.lit("!!!"))) is None
    assert value(spark, C.company_core(F.lit("Công ty TNHH Golden Gate"))) == "golden gate"
    assert value(spark, C.company_core(F.lit("Công ty TNHH ABC"))) is None


def test_fingerprint_ignores_case_and_space(spark):
    assert value(spark, C.fingerprint(F.lit("A  b"), F.lit("C\n d "))) == value(spark, C.fingerprint(F.lit("a b"), F.lit("c d")))


@pytest.mark.parametrize("title,company,text,want", [("Sorry, you have been blocked", "", "", True), ("www.topcv.vn", "", "", True), ("Java developer", "", "", False), ("captcha", "ACME", "", False), ("captcha", "", "a long enough text", False)])
def test_blocked(spark, title, company, text, want):
    assert value(spark, C.blocked(F.lit(title), F.lit(company), F.lit(text))) is want


def test_cosine_and_ratio(spark):
    a = F.array(F.lit(1.0), F.lit(0.0))
    assert value(spark, C.cosine(a, a)) == 1.0
    assert value(spark, C.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) is None
    assert value(spark, C.name_ratio(F.lit("react"), F.lit("reacts"))) == pytest.approx(5 / 6)
