"""Language-model scores by a weighted backoff automaton.

The model interpolates n-gram counts with a Dirichlet prior (mass PRIOR on the next lower
order): p(w | h) = (c(hw) + PRIOR * p(w | h')) / (c(h) + PRIOR), and the lowest order is
(c(w) + 0.5) / (N + 0.5 (V + 1)).  As an automaton: the empty context is the root, and an
n-gram shorter than ORDER with training count is a state; an n-gram hw with training count
is an arc from h that reads w, has the weight log10 p(w | h) and leads to the longest state
that hw ends in; the root has an arc for every word.  A failure arc leads from h to its
suffix h' with the weight log10 (PRIOR / (c(h) + PRIOR)).  A text is read once from left to
right: the state is carried from token to token, fails until an arc fits, takes it, and the
weights on the way add up to log10 of the text's probability.

The automaton of the whole corpus is never in one place.  Blocks of documents send their
distinct n-grams with their own training counts, cut into fragments of the hash order; the
fragments add the counts of all blocks and send them back, so each block has the part of
the automaton that its own texts can reach, with counts of the whole corpus.  Fragments
are as many as the input's size asks for.

N-grams are known by 61 bits of hash.  Two that share them would add their counts, a wrong
weight for those two only: of 10^12 different n-grams about one in five million.

Defined cases: a null or empty text has one token, the end; a very long text is a block of
its own; held-out documents add nothing to counts; a null doc_id counts as empty text in
the fold; without training documents every count is 0; repeated rows count as often as they
occur; equal texts have equal scores; an empty table gives no rows; other columns don't
matter, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import (
    BLOCK_SCHEMA,
    follow,
    fragment_bounds,
    lower_ascii,
    mix,
    open_block,
    pack_blocks,
    pack_numbers,
    pack_sorted,
    span_hashes,
    unpack_numbers,
    unpack_sorted,
    word_spans,
)
from .shared import cut, fragment_count, settled

ORDER, PRIOR = 2, 512.0
HELD_OUT = 1  # this remainder of the fold isn't learned from
BEGIN, END = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x5851F42D4C957F2D)
ORDER_BITS = np.uint64(7)  # the lowest bits of a key are its n-gram's order
BEGIN_KEY = np.uint64(0x9FB21C651E98DF20)  # of order 0, as no n-gram's key is
FEW = 16  # documents from which on they are read together


class Grams(NamedTuple):
    first: np.ndarray  # first token of each document, and the number of tokens
    keys: np.ndarray  # distinct, ascending; the lowest bits are the order
    node: list[np.ndarray]  # for each order and token, the place of the n-gram that ends there, or -1


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> Grams:
    """The n-grams of a block.  Each document has the begin as context of its first token, and an end as its last token."""
    if not 1 <= order <= int(ORDER_BITS):
        raise ValueError(f"orders of 1 to {ORDER_BITS} can be told apart, not {order}")
    data = lower_ascii(data)
    starts, lengths, words = word_spans(data, offsets)
    h = span_hashes(data, starts, lengths) if len(starts) else np.zeros(0, np.uint64)
    token = np.insert(h, words[1:], END)
    first = words + np.arange(len(words))
    at = np.arange(len(token)) - np.repeat(first[:-1], np.diff(first))
    run, keys, live = token, [(mix(token) & ~ORDER_BITS) | np.uint64(1)], [np.ones(len(token), bool)]
    for k in range(2, order + 1):
        before = np.roll(run, 1)
        if k == 2:
            before = np.where(at == 0, BEGIN, before)
        run = follow(before, token)
        keys.append((mix(run) & ~ORDER_BITS) | np.uint64(k))
        live.append(at >= k - 2)
    unique, where = np.unique(np.concatenate([[BEGIN_KEY], *(x[m] for x, m in zip(keys, live, strict=True))]), return_inverse=True)
    node, done = [], 1
    for m in live:
        own = np.full(len(token), -1)
        own[m] = where[done : done + int(m.sum())]
        done += int(m.sum())
        node.append(own)
    return Grams(first, unique, node)


def in_training(doc_ids: list[int | None]) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % 5 != HELD_OUT for i in doc_ids], bool)


def own_counts(g: Grams, training: np.ndarray) -> np.ndarray:
    """Training counts of a block's n-grams; the begin counts documents."""
    learned = np.repeat(training, np.diff(g.first))
    counts = np.zeros(len(g.keys), np.int64)
    for node in g.node:
        counts += np.bincount(node[learned & (node >= 0)], minlength=len(g.keys))
    counts[np.searchsorted(g.keys, BEGIN_KEY)] = int(training.sum())
    return counts


def fragments(blocks: DataFrame, order: int, n: int) -> DataFrame:
    """block, frag, keys, counts of each block's n-grams in each fragment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                g = grams(*open_block(b["sizes"], b["body"]), order)
                counts, edges = own_counts(g, in_training(b["doc_ids"])), fragment_bounds(g.keys, n)
                live = [i for i in range(n) if edges[i + 1] > edges[i]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b["block"]] * len(live), pa.int64()), pa.array(live, pa.int32()), pa.array([pack_sorted(g.keys[edges[i] : edges[i + 1]]) for i in live], pa.binary()), pa.array([pack_numbers(counts[edges[i] : edges[i + 1]], 4) for i in live], pa.binary())],
                    ["block", "frag", "keys", "counts"],
                )

    return blocks.mapInArrow(run, "block long, frag int, keys binary, counts binary")


def add_counts(parts: DataFrame) -> DataFrame:
    """block, frag, counts: the corpus's counts of a part's n-grams in order; tokens, types: of a fragment, on one of its rows."""

    def run(table: pa.Table) -> pa.Table:
        keys = [unpack_sorted(x) for x in table.column("keys").to_pylist()]
        counts = np.concatenate([unpack_numbers(x, 4) for x in table.column("counts").to_pylist()])
        unique, where = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(where, counts).astype(np.int64)
        words = total[(unique & ORDER_BITS) == 1]
        edges = np.cumsum([0] + [len(k) for k in keys])
        rest = [0] * (len(keys) - 1)
        packed = [pack_numbers(total[where[a:b]]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pa.table(
            [table.column("block"), table.column("frag"), pa.array(packed, pa.binary()), pa.array([int(words.sum()), *rest], pa.int64()), pa.array([int((words > 0).sum()), *rest], pa.int64())],
            ["block", "frag", "counts", "tokens", "types"],
        )

    return parts.groupBy("frag").applyInArrow(run, "block long, frag int, counts binary, tokens long, types long")


class Automaton:
    """The states, arcs and failure arcs that a block's texts can reach, with the corpus's counts.

    Nodes are the block's n-grams, by their place in its keys, and the root.  As a state a
    node has a length (words of context) and a failure arc (``suffix``, ``fail``); as an
    arc, which reads its last word in the state of its other words, a ``target`` and a
    ``weight``.  ``arcs`` has the arc that reads a token in a state of each length, or -1."""

    def __init__(self, g: Grams, counts: np.ndarray, tokens: int, types: int, prior: float):
        n, order = len(g.keys), len(g.node)
        begin, root = int(np.searchsorted(g.keys, BEGIN_KEY)), n
        known = np.append(counts > 0, True)
        self.length, self.suffix, self.target = np.zeros(n + 1, np.int8), np.full(n + 1, root), np.full(n + 1, root)
        self.arcs = np.stack(g.node)
        p = np.ones(n + 1)
        words = np.unique(g.node[0])
        p[words] = (counts[words] + 0.5) / (tokens + 0.5 * (types + 1))
        for k in range(1, order):
            node, at = np.unique(g.node[k], return_index=True)
            live = node >= 0
            node, at = node[live], at[live]
            context = np.where(np.isin(at, g.first[:-1]), begin, g.node[k - 1][at - 1])
            self.suffix[node] = g.node[k - 1][at]
            p[node] = (counts[node] + prior * p[self.suffix[node]]) / (counts[context] + prior)
            self.arcs[k] = np.where((g.node[k] >= 0) & known[g.node[k]], g.node[k], -1)
            self.length[node] = k + 1
            self.target[node] = node if k + 1 < order else self.suffix[node]
        if order > 1:
            self.length[words], self.length[begin] = 1, 1
            self.target[words] = np.where(known[words], words, root)
        self.weight = np.log10(p)
        self.fail = np.append(np.log10(prior / (counts + prior)), 0.0)
        self.start = begin if order > 1 and known[begin] else root

    def read(self, g: Grams) -> np.ndarray:
        """log10 probability of each document: one pass from left to right, in which many documents take their step at once and the longest few go on alone."""
        lengths = np.diff(g.first)
        rank = np.argsort(-lengths, kind="stable")
        ends, first = lengths[rank], g.first[:-1][rank]
        state, total = np.full(len(rank), self.start), np.zeros(len(rank))
        at, live = 0, len(rank)
        while live > FEW:
            token, s = first[:live] + at, state[:live]
            arc, lost = self.arcs[self.length[s], token], np.zeros(live)
            failed = np.flatnonzero(arc < 0)
            while len(failed):
                lost[failed] += self.fail[s[failed]]
                s[failed] = self.suffix[s[failed]]
                arc[failed] = self.arcs[self.length[s[failed]], token[failed]]
                failed = failed[arc[failed] < 0]
            total[:live] += lost + self.weight[arc]
            state[:live] = self.target[arc]
            at += 1
            while live and ends[live - 1] <= at:
                live -= 1
        if live:
            length, suffix, fail, weight, target = (x.tolist() for x in (self.length, self.suffix, self.fail, self.weight, self.target))
        for i in range(live):
            s, gained = int(state[i]), float(total[i])
            for arcs in self.arcs[:, first[i] + at : first[i] + ends[i]].T.tolist():
                lost = 0.0
                while (arc := arcs[length[s]]) < 0:
                    lost += fail[s]
                    s = suffix[s]
                gained += lost + weight[arc]
                s = target[arc]
            total[i] = gained
        out = np.empty(len(rank))
        out[rank] = total
        return out


#: Text of a block: its automaton takes about a hundred bytes for each byte of it, twice on an executor of two cores.
BLOCK_BYTES = 4 << 20


def score(documents: DataFrame, order: int = ORDER, prior: float = PRIOR) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    n = fragment_count(documents)
    packed = settled(documents).mapInArrow(lambda batches: pack_blocks(batches, BLOCK_BYTES), BLOCK_SCHEMA)
    counted = cut(add_counts(fragments(packed, order, n)))
    sums = counted.agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).first()
    tokens, types = sums["tokens"] or 0, sums["types"] or 0
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("frag")
        counts = np.concatenate([unpack_numbers(x) for x in right.column("counts").to_pylist()] or [np.zeros(0)]).astype(np.int64)
        out = []
        for b in left.to_pylist():
            g = grams(*open_block(b["sizes"], b["body"]), order)
            machine = Automaton(g, counts, tokens, types, prior)
            by_doc = lambda x: np.add.reduceat(x, g.first[:-1])  # noqa: E731, B023
            out.append(
                pa.table(
                    [pa.array(b["doc_ids"], pa.int64()), pa.array(~in_training(b["doc_ids"])), pa.array(np.diff(g.first), pa.int64()), pa.array(by_doc((counts[g.node[0]] > 0).astype(np.int64)), pa.int64()), pa.array([tokens] * len(b["doc_ids"]), pa.int64()), pa.array(by_doc(machine.weight[g.node[0]])), pa.array(machine.read(g))],
                    names,
                )
            )
        return pa.concat_tables(out)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return packed.repartition(n, "block").groupBy("block").cogroup(counted.select("block", "frag", "counts").groupBy("block")).applyInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    from .shared import table

    return score(table(spark, sf_dir, "documents"))
