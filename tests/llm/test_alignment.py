"""Alignment of two tokenizers against whole-text encodings and plain loops."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tests.llm import fixture
from tidemark.llm import op13_alignment


@pytest.fixture(scope="module")
def coders():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    sign = {chr(c): c for c in plain} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in plain)}

    def encode(text):
        if not text:
            return [], []
        left = a.encode(" " + text, add_special_tokens=False).ids
        right = b.encode(text)
        body_a = [bytes(sign[c] for c in a.id_to_token(i)) for i in left]
        body_b = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in right]
        if not b"".join(body_a) == b"".join(body_b) == (" " + text).encode():
            return [], []
        return list(zip(left, body_a)), list(zip(right, body_b))

    return encode


def spans(tokens):
    at, out = 0, []
    for i, body in tokens:
        out.append((i, at, at + len(body)))
        at += len(body)
    return out


def brute(texts, encode):
    made, counts = [], collections.Counter()
    for i, text in texts:
        a, b = (spans(x) for x in encode(text))
        links, start = [], 0
        for x, s, e in a:
            while start < len(b) and b[start][2] <= s:
                start += 1
            k = start
            while k < len(b) and b[k][1] < e:
                links.append((x, b[k][0]))
                k += 1
        counts.update(set(links))
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, low = [], 0
        for high in ends:
            groups.append("|".join(",".join(str(x) for x, s, e in side if s >= low and e <= high) for side in (a, b)) if len(a) < 3000 else "")
            low = high
        made.append((i, a, b, links, len(ends), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    best = collections.defaultdict(int)
    for (x, _), c in counts.items():
        best[x] = max(best[x], c)
    return counts, best, [(i, len(a), len(b), g, len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), sha if len(a) < 3000 else None) for i, a, b, links, g, sha in made]


def got(frame):
    return sorted(((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"] if r["n_a"] < 3000 else None) for r in frame.collect()), key=repr)


HOSTILE = ["a", "B", "é", " ", "  ", "\n", "\t", " ", "　", "▁", "日本", "語", "'s", "12", "!!", "<s>", "</s>", "<0x0A>", "<|endoftext|>", "\x00", "word", "don't", "😀", "é", "\r"]


@pytest.mark.parametrize("group_rows,limit", [(4_000_000, 4 << 20), (3, 2000)])
def test_alignment_equals_plain_loops(spark, coders, group_rows, limit):
    """Also with many small blocks, added up in groups."""
    rng = random.Random(5)
    texts = fixture.texts() + [(1000 + i, "".join(rng.choice(HOSTILE) for _ in range(rng.randint(1, 40)))) for i in range(120)] + [(2000, " "), (2001, "  "), (2002, "x "), (2003, " x"), (2004, "x  ")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    counts, best, want = brute(texts, coders)
    assert got(op13_alignment.align(docs, group_rows=group_rows, limit=limit)) == sorted(want, key=repr)
    if group_rows == 3:
        pairs = {(r["a_id"], r["b_id"]): (r["documents"], r["best"]) for r in op13_alignment.id_pairs(docs, group_rows=group_rows, limit=limit).collect()}
        assert pairs == {p: (c, c == best[p[0]]) for p, c in counts.items()}


def test_nulls_empty_table_and_clashing_names(spark):
    docs = fixture.documents(spark).withColumns({c: F.lit(c) for c in ("stripe", "part", "keys", "counts", "best", "pairs", "times")})
    rows = {r["doc_id"]: r for r in op13_alignment.align(docs).collect()}
    assert [rows[1][c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")] == [0] * 6 + [""] == [rows[2][c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")]
    assert len(rows) == len({i for i, _ in fixture.texts()})
    assert op13_alignment.align(docs.limit(0)).count() == 0
