"""Quality rules against plain loops."""

import collections
import re

import pytest
from pyspark.sql import functions as F

from tests.llm import fixture
from tidemark.llm import op11_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = "The river turned slowly under the old stone bridge while seven people watched it from the bank."


def counts(text):
    ws = WORD.findall(text)
    triples = list(zip(ws, ws[1:], ws[2:]))
    times = collections.Counter(triples)
    inside = {i + k for i, t in enumerate(triples) if times[t] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def numbered(texts):
    return [(i, t, "x") for i, t in enumerate(texts)]


def test_counts_equal_plain_loops(spark):
    repeated = ["a a a a", "a b c a b c", "a b c d a b c", "x\n\nx\n \nx", "one\r\ntwo\r\none\r", "#*$%&|<> é#", "w " * 3000, "\x0b\x0cword\x1c"]
    docs = fixture.documents(spark)
    docs = docs.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(repeated)], "doc_id long, text string"))
    got = collections.Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in op11_quality.judged(docs).collect())
    want = collections.Counter((i, *counts(t)) for i, t in [*fixture.texts(), *((100 + i, t) for i, t in enumerate(repeated))])
    assert got == want


def prose(n):
    return "\n".join(f"{w} {PROSE}" for w in ("First", "Then", "Later", "Again", "Soon", "Once", "Last")[:n])


LINES = [
    ("Home | News | Sport | Contact us.", "navigation"),
    ("Read more.", "navigation"),
    ("All rights reserved.", "boilerplate"),
    ("This work is licensed under the Example License.", "boilerplate"),
    ("a line without an end", "unfinished"),
    ("- a point of a list", "unfinished"),
]


@pytest.mark.parametrize("line,rule", LINES)
def test_lines_that_fail_are_removed_and_the_document_stays(spark, line, rule):
    text = "\n".join(f"{w} walked {a} miles {b}." for w, a, b in zip("He She They We You Anna Ben Carl Dora Emil Finn Greta".split(), range(12), "up down left right home out in over under back away near".split()))
    row = op11_quality.judged(spark.createDataFrame([(1, f"{text}\n{line}\n")], "doc_id long, text string")).first()
    assert (row["n_lines"], row[f"n_{rule}"], row["base_failed"], row["kept"], row["cleaned"]) == (13, 1, False, True, text)


@pytest.mark.parametrize("line", ["He said: “Stop!”", "Is it?)  ", "Home is where one reads more books.", "Wait…"])
def test_lines_of_prose_stay(spark, line):
    row = op11_quality.judged(spark.createDataFrame([(1, line)], "doc_id long, text string")).first()
    assert row["cleaned"] == line


def test_a_document_that_loses_too_much_is_rejected(spark):
    words = [f"word{i}" for i in range(120)]
    half = " ".join(words[:60]) + ".\n" + " ".join(words[60:])
    most = " ".join(words[:100]) + ".\n" + " ".join(words[100:])
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in op11_quality.judged(spark.createDataFrame([(1, half), (2, most), (3, "few words."), (4, f"{PROSE} " * 9)], "doc_id long, text string")).collect()}
    assert got == {1: (False, False), 2: (False, True), 3: (True, False), 4: (True, False)}


def test_clean_keeps_columns_with_clashing_names_and_an_empty_table(spark):
    docs = fixture.documents(spark).withColumns({c: F.lit(c) for c in ("body", "listed", "lines", "windows", "starts", "row", "failed", "cleaned", "numbers")})
    out = op11_quality.clean(docs)
    assert out.columns == docs.columns
    assert op11_quality.judged(fixture.empty(spark)).count() == op11_quality.clean(docs.limit(0)).count() == 0


def test_hashes_that_clash_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(op11_quality, "PLACE_BITS", 62)  # two bits of hash are left
    texts = ["a b c d e f g a b c h i j k", "u v w x y z u v x w u v w"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_repeat_words"] for r in op11_quality.judged(frame).collect()} == {i: counts(t)[4] for i, t in enumerate(texts)}
