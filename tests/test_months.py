"""Monthly series whose articles run ahead of the postings."""

import datetime as dt

from tidemark.operators import gold


def series(spark):
    day = dt.date
    jobs = spark.createDataFrame([("Go", day(2026, 4, 1), 2), ("Go", day(2026, 5, 1), 4), ("Rust", day(2026, 5, 1), 3)], "tech string, month date, job_count long")
    articles = spark.createDataFrame([("Go", day(2026, 5, 1), 1), ("Go", day(2026, 8, 1), 9), ("Zig", day(2026, 7, 1), 5), ("Java", day(2026, 3, 1), 1)], "tech string, month date, article_count long")
    snapshot = spark.createDataFrame([("Go", 5), ("Rust", 3)], "tech string, job_count long")
    as_of = spark.createDataFrame([(day(2026, 5, 1),)], "as_of date")
    return gold.tech_analytics(jobs, articles, snapshot, as_of), as_of


def test_months_after_the_last_posting_are_left_out(spark):
    months, _ = series(spark)
    assert {(r["tech"], str(r["month"]), r["job_count"]) for r in gold.latest(months).collect()} == {("Go", "2026-05-01", 5), ("Rust", "2026-05-01", 3), ("Java", "2026-03-01", 0)}
    assert [(r["tech"], r["job_count"]) for r in gold.top_technologies(months).collect()] == [("Go", 5), ("Rust", 3), ("Java", 0)]
    assert [(r["tech"], r["ranking"]) for r in months.filter("ranking IS NOT NULL").orderBy("ranking").collect()] == [("Go", 1), ("Rust", 2)]
    assert [(r["tech"], r["mom_growth"]) for r in gold.trending(months).collect()] == [("Go", 150.0), ("Rust", 0.0)]


def test_new_technologies_are_those_of_the_current_month(spark):
    months, as_of = series(spark)
    assert gold.new_technologies(months, as_of).first()[0] == 1  # Rust; Java came first, Go earlier, Zig isn't here yet
    assert {(str(r["month"]), r["new_technologies"]) for r in gold.new_by_month(months).collect()} == {("2026-03-01", 1), ("2026-04-01", 1), ("2026-05-01", 1)}
