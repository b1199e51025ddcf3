"""Merkle manifests against a plain tree of lists."""

import collections
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm import fixture
from tidemark.llm import op12_merkle


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(i, source, lang, n, text):
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text))


def climb(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def sides(levels, at):
    for level in levels[:-1]:
        run = at // 16 * 16
        yield level[run:at], level[at + 1 : run + 16]
        at //= 16


def brute(rows):
    trees = collections.defaultdict(list)
    for i, text, lang, source, n in rows:
        changed = text if text is None or i is None or zlib.crc32(str(i).encode()) % 5 else fixture.lower(text)
        trees[source].append(((i is not None, i or 0), leaf(i, source, lang, n, text), leaf(i, source, lang, n, changed), i))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: climb([x[1] for x in sorted(trees[s])]) for s in names}
    top = climb([own[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for at, (_, node, other, i) in enumerate(sorted(trees[s])):
            beside = [*sides(own[s], at), *sides(top, k)]
            found = other
            for before, after in beside:
                found = h([*before, found, *after])
            root = top[-1][0]
            out.append((i, node, own[s][-1][0], root, h(x for pair in beside for run in pair for x in run), found, found == root))
    return collections.Counter(out)


def got(frame):
    return collections.Counter(tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in frame.collect())


def test_manifest_of_awkward_rows(spark):
    assert got(op12_merkle.manifest(op12_merkle.leaves(fixture.documents(spark)))) == brute(fixture.rows())


@pytest.mark.parametrize("block", [16, 256])
def test_sources_of_many_blocks_and_many_sources(spark, block):
    sizes = [0, 1, 2, 15, 16, 17, 31, 32, 33, 255, 256, 257, 272, 700, *([1] * 20)]
    rows = [(10_000 - 7 * n - i if i % 50 else n, f"Text {i % 9}", "en", None if s == 3 else f"s{s}", i) for s, n in enumerate(sizes) for i in range(n)]
    rows += [(1, "Same ROW", "en", "s3", 8)] * 40 + [(None, "No id", "en", "", k) for k in range(18)]
    docs = spark.createDataFrame(rows, fixture.SCHEMA).repartition(7)
    assert got(op12_merkle.manifest(op12_merkle.leaves(docs), block)) == brute(rows)


def test_a_changed_text_is_noticed_and_others_are_verified(spark):
    rows = [(i, "Text" if i % 3 else "text", "en", f"s{i % 4}", 4) for i in range(400)]
    out = op12_merkle.manifest(op12_merkle.leaves(spark.createDataFrame(rows, fixture.SCHEMA)))
    assert {r["doc_id"] for r in out.filter("NOT verified").collect()} == {i for i in range(400) if i % 3 and zlib.crc32(str(i).encode()) % 5 == 0}


def test_empty_table_and_clashing_names(spark):
    assert op12_merkle.manifest(op12_merkle.leaves(fixture.empty(spark))).count() == 0
    docs = fixture.documents(spark).withColumns({c: F.lit(c) for c in ("tree", "place", "size", "key", "node", "other", "leaf", "_part", "_row", "_seen")})
    assert got(op12_merkle.manifest(op12_merkle.leaves(docs))) == brute(fixture.rows())
