"""Nearest names and quantiles against brute force."""

import random

import numpy as np
import pytest

from tidemark.operators import gold, names


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def nearest_brute(queries, known, least):
    out = {}
    for q in {q for q in queries if q}:
        scored = [(-(1 - edits(q, n) / max(len(q), len(n))), n) for n in known if n]
        best = min(scored, default=None)
        if best and -best[0] >= least:
            out[q] = (best[1], round(-best[0], 9))
    return out


@pytest.mark.parametrize("least", [0.55, 0.6, 0.8, 1.0])
def test_nearest_names_equal_all_pairs(spark, least):
    draw = random.Random(7)
    word = lambda most: "".join(draw.choice("abc") for _ in range(draw.randint(1, most)))
    known = [word(14) for _ in range(60)] + ["né", "naïve", "part 0001", "part 0002", "part 0001", None, ""]
    asked = [word(16) for _ in range(60)] + ["part 0003", "xpart 0002y", "zzzzzzzzzzzzzzz", "a", "né", None, "", "a"]
    q, n = spark.createDataFrame([(x,) for x in asked], "q string"), spark.createDataFrame([(x,) for x in known], "name string")
    got = [(r["q"], (r["name"], round(r["s"], 9))) for r in names.nearest_names(q, n, least).collect()]
    want = nearest_brute(asked, known, least)
    assert len(got) == len(want) and dict(got) == want and len(want) > 3


def test_nearest_names_of_empty_tables_and_low_ratios(spark):
    none, one = spark.createDataFrame([], "q string"), spark.createDataFrame([("abc",)], "name string")
    assert names.nearest_names(none, one).count() == 0
    assert names.nearest_names(one.toDF("q"), one.limit(0)).count() == 0
    with pytest.raises(ValueError):
        names.nearest_names(none, one, 0.5)


def test_quantiles_equal_sorted_values(spark):
    draw = random.Random(3)
    pays = {"hot": [draw.choice([None, 10.0, 20.5, float(draw.randint(0, 40))]) for _ in range(400)], "few": [3.0, 1.0], "one": [7.5], "none": [None], "even": [1.0, 2.0, 4.0, 8.0]}
    rows = spark.createDataFrame([(t, x) for t, xs in pays.items() for x in xs], "tech string, pay double")
    shares = {"low": 0.25, "mid": 0.5, "high": 0.75, "top": 1.0}
    got = {r["tech"]: [r[c] for c in shares] for r in gold.quantiles(rows, shares).collect()}
    want = {t: [float(np.quantile([x for x in xs if x is not None], p)) for p in shares.values()] for t, xs in pays.items() if t != "none"}
    assert got.keys() == want.keys()
    for t in want:
        assert got[t] == pytest.approx(want[t])


def test_pay_statistics_keep_technologies_without_pays_last(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None), ("b", None), ("c", 9.0)], "tech string, pay double")
    out = [(r["tech"], r["jobs"], r["median_pay"], r["p75_pay"]) for r in gold.pay_statistics(rows, 2, 5).collect()]
    assert out == [("a", 2, 2.0, 2.5), ("b", 2, None, None)]
