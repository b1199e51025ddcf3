"""Queries over whole tables against brute force."""

import collections
import datetime as dt
import hashlib
import re

from tidemark.functions.vocabulary import TECH_TERMS
from tidemark.plans import registry


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def smallest_of_sets(pairs):
    """Union-find: the smallest node that each one is joined with."""
    link = {}

    def root(x):
        while link.setdefault(x, x) != x:
            x = link[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        link[max(x, y)] = min(x, y)
    return {x: root(x) for x in link}


def test_components_of_all_customers_and_suppliers(spark, tmp_path):
    day = dt.date(2026, 1, 1)
    orders = [(100 + k, 1 + k % 5, day) for k in range(10)] + [(200, 8, day), (201, 9, day), (202, 9, day)]
    lines = [(100, 1), (101, 1), (102, 2), (103, 2), (104, 3), (200, 7), (201, 7), (300, 12), (300, 13)] + [(400 + k, 50 + k + i) for k in range(70) for i in (0, 1)]
    write(spark, tmp_path, "orders", orders, "o_orderkey long, o_custkey long, o_orderdate date")
    write(spark, tmp_path, "lineitem", lines, "l_orderkey long, l_suppkey long")
    want = smallest_of_sets([(f"c{c}", f"o{o}") for o, c, _ in orders] + [(f"s{s}", f"o{o}") for o, s in lines])
    got = [tuple(r) for r in registry.QUERIES["o133_components"](spark, str(tmp_path)).select("id", "component").collect()]
    assert len(got) == len(want) and dict(got) == want
    assert len(collections.Counter(want.values())) == 6


def terms_brute(text):
    keys = "|".join(re.escape(k) for k in sorted(TECH_TERMS, key=len, reverse=True))
    return sorted({TECH_TERMS[k] for k in re.findall(rf"(?<!\w)(?:{keys})(?!\w)", (text or "").lower())})


def test_entities_of_every_text(spark, tmp_path):
    texts = ["Python and JavaScript, not Javanese", "C++ or C# or c", "no technology", None, "", "học máy với Spring Boot", "Node.js, node.js; NODE.JS", "MySQL SQL", "sparkling", "é-python é python3 (Rust)"]
    write(spark, tmp_path, "benchmark", list(enumerate(texts)), "item_id long, text string")
    got = {r["item_id"]: (r["found"], r["n"]) for r in registry.QUERIES["o042_query_entities"](spark, str(tmp_path)).collect()}
    assert got == {i: (",".join(terms_brute(t)), len(terms_brute(t))) for i, t in enumerate(texts)}
    assert got[0] == ("JavaScript,Python", 2) and got[3] == ("", 0)


def test_hashes_and_terms_of_every_document(spark, tmp_path):
    rows = [(1, None, "en"), (2, "", None), (3, " The\tCAFÉ\u00a0 crème\u2003\n", "EN"), (4, "the café crème", "fr"), (5, "“Straße”  ΟΔΟΣ", ""), (6, "\u3000x\x1fy\x85", "de"), (7, "other", "The"), (8, "\u00a0", "En"), (9, "thé éthe", None)]
    write(spark, tmp_path, "documents", rows, "doc_id long, text string, lang string")
    clean = lambda t: re.sub(r"\s+", " ", f" {t or ''}".lower().strip())
    hashes = [tuple(r) for r in registry.QUERIES["o031_content_hash"](spark, str(tmp_path)).collect()]
    assert sorted(hashes) == [(i, hashlib.md5(clean(t).encode()).hexdigest()) for i, t, _ in rows]
    terms = [tuple(r) for r in registry.QUERIES["o108_term_union"](spark, str(tmp_path)).collect()]
    assert sorted(terms) == [(i, ",".join(sorted({*re.findall(r"\bThe\b", re.sub(r"(?i)\bthe\b", "The", t or "")), *([] if x is None else [x])}))) for i, t, x in rows]
