"""Stages of the pipeline on documents with awkward ids and near copies."""

import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from tests.llm import fixture, test_lossless
from tidemark.llm import op2_toxicity, op3_exact_dedup, op10_jaccard
from tidemark.llm.blocks import text_bytes


def near_copies():
    rng = random.Random(11)
    base = [f"w{rng.randint(0, 10**9)}" for _ in range(200)]
    changed = list(base)
    for at in (20, 60, 100, 140):  # 2 % of the words
        changed[at] = f"other{at}"
    other = [f"v{rng.randint(0, 10**9)}" for _ in range(200)]
    half = [*other[:100], *(f"u{rng.randint(0, 10**9)}" for _ in range(100))]
    return [(1, " ".join(base)), (2, " ".join([*base, *(f"added{i}" for i in range(40))])), (3, " ".join(changed)), (4, " ".join(other)), (5, " ".join(half))]


def test_near_dedup_links_copies_with_a_passage_added_or_some_words_changed(spark):
    docs = spark.createDataFrame(near_copies(), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 4, 5]


#: Ids that are null, or repeated with other texts; the last row repeats one wholly.
AWKWARD = [(None, "green river under cold stone light"), (None, "a quite different text without any id"), (None, "you grumblefink of all"), (7, "seven walks in one house today"), (7, "another seven sits by the window"), (7, "you grumblefink again"), (3, "seven walks in one house today"), (None, None), (8, ""), (8, "ÄÖ Zwei Wörter und noch einige mehr"), (8, "ÄÖ zwei wörter und noch einige mehr"), (7, "another seven sits by the window")]


def awkward(spark):
    return spark.createDataFrame(AWKWARD, "doc_id long, text string").repartition(3)


def rows(frame):
    return sorted(((r["doc_id"], r["text"]) for r in frame.collect()), key=repr)


def test_exact_dedup_keeps_one_row_of_each_text(spark):
    got = rows(op3_exact_dedup.deduplicate(awkward(spark)))
    eight = [r for r in got if (r[1] or "").startswith("ÄÖ")]
    assert len(eight) == 1 and eight[0] in AWKWARD
    assert [r for r in got if r not in eight] == sorted([*AWKWARD[:6], (8, "")], key=repr)


def test_near_dedup_keeps_one_row_of_each_component(spark):
    got = rows(op10_jaccard.keep_one(awkward(spark), 5, (80, 100)))
    eight = [r for r in got if (r[1] or "").startswith("ÄÖ")]
    assert len(eight) == 1 and eight[0] in AWKWARD
    assert [r for r in got if r not in eight] == sorted([*AWKWARD[:3], AWKWARD[4], AWKWARD[5], *AWKWARD[6:9]], key=repr)


def test_toxic_rows_go_without_others_of_their_id(spark, monkeypatch):
    def toxic_word(texts, toxic):
        weights = np.zeros((1 << op2_toxicity.BITS) + 2)
        weights[-1] = op2_toxicity.BIAS
        ids, *_ = op2_toxicity._features(*text_bytes(pa.array(["grumblefink"])))
        weights[ids[ids < 1 << op2_toxicity.BITS]] = 5.0
        return weights

    monkeypatch.setattr(op2_toxicity, "fit", toxic_word)
    labels = spark.createDataFrame([(7, 1), (3, 0)], "doc_id long, toxic int")
    docs = awkward(spark)
    out = op2_toxicity.remove_toxic(docs, labels)
    assert out.columns == docs.columns
    assert rows(out) == sorted((r for r in AWKWARD if "grumblefink" not in (r[1] or "")), key=repr)


def test_whole_pipeline_on_awkward_and_empty_tables(spark, tmp_path):
    docs = fixture.documents(spark)
    labels = spark.createDataFrame([(i, 0, 0) for i in (4, 10, 40, 60)], "doc_id long, quality int, toxic int")
    for name, frame in (("awkward", docs), ("empty", docs.limit(0))):
        frame.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    texts = {}
    for i, text in fixture.texts():
        texts.setdefault(i, set()).add(text)
    out = corpus_pipeline.run(spark, f"{tmp_path}/awkward")
    encoding = test_lossless.tiktoken_encoding()
    rows = out.collect()
    assert rows and {tuple(r["ids"]) for r in rows} == {tuple(r["ids"]) for r in rows if any(encoding.encode_ordinary(t) == list(r["ids"]) for t in texts[r["doc_id"]])}
    assert len({tuple(r["ids"]) for r in rows}) == len(rows)  # no text stays twice
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").collect() == []
