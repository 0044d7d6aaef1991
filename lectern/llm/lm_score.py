"""Language-model scores by a weighted backoff automaton.

The model is a bigram model smoothed towards unigrams. As an automaton: every context word is
a state; a state has an arc for each word seen after it, weighted with the smoothed
log-probability, and one failure arc, weighted with the log of the mass left, to the root
state, which has an arc for every word. A text is read once from left to right: follow the
state's arc for the next token or else its failure arc and the root's, add the weights, and
go on in the state of the token.

With c(.) counts in training tokens, N all of them and V the distinct ones:

    root arc        p(v) = (c(v) + 0.5) / (N + 0.5 (V + 1))
    arc u -> v      (c(u, v) + K p(v)) / (c(u) + K)
    failure arc u   K / (c(u) + K)

Counts are those of the whole training corpus and grow with it, so no machine holds the
model: the n-grams of each block of documents get their counts by ``exchange``, and a block
walks the part of the automaton that its texts can reach.

Cases: a null or empty text is the end token alone; without training documents every
probability is that of one unseen token; repeated rows count and are scored each; an empty
table gives no rows; other columns are carried in the struct ``doc`` where asked for. Tokens
are told apart by 62-bit digests.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import exchange
from lectern.llm.text import SPACED, Words, mix, pair, row_sums, runs

#: pseudo-count of the unigram distribution in every context
PULL = 1000.0
_END, _START = mix(np.array([0xE7D, 0x57A], dtype=np.uint64))
_TAG = np.uint64(2)


class _Tokens:
    """Tokens of a block: each text's words and one end, with n-gram keys.

    Bit 1 of a key tells a bigram from a word; bit 0 is left free.
    """

    def __init__(self, block: pa.Table) -> None:
        words = Words(block.column("text"), SPACED, lower=True)
        n = len(words.counts)
        self.first = words.first + np.arange(n + 1)
        self.digests = np.empty(len(words) + n, dtype=np.uint64)
        ends = self.first[1:] - 1
        inner = np.ones(self.digests.size, dtype=bool)
        inner[ends] = False
        self.digests[inner] = words.digests()
        self.digests[ends] = _END
        before = np.empty_like(self.digests)
        before[1:] = self.digests[:-1]
        before[self.first[:-1]] = _START
        self.words = self.digests & ~np.uint64(3)
        self.pairs = (pair(before, self.digests) & ~np.uint64(3)) | _TAG
        self.learn = np.repeat(block.column("learn").to_numpy().astype(bool), np.diff(self.first))

    def counts(self) -> tuple[np.ndarray, np.ndarray, None]:
        """Distinct keys and how often each stands in training texts."""
        idle = (~self.learn).astype(np.uint64)
        key = np.sort(np.concatenate([self.words | idle, self.pairs | idle]))
        taught = (key & np.uint64(1)) == 0
        key &= ~np.uint64(1)
        start, _ = runs(key)
        total = np.add.reduceat(taught.astype(np.uint64), start) if start.size else start.astype(np.uint64)
        return key[start], total, None


class _Numbered:
    """Distinct keys with their training counts, and the number of each token's key."""

    def __init__(self, keys: np.ndarray, learn: np.ndarray) -> None:
        order = np.argsort(keys)
        ranked = keys[order]
        head = np.ones(keys.size, dtype=bool)
        head[1:] = ranked[1:] != ranked[:-1]
        start = np.flatnonzero(head)
        self.keys = ranked[start]
        self.own = np.add.reduceat(learn[order].astype(np.uint64), start) if start.size else start.astype(np.uint64)
        self.number = np.empty(keys.size, dtype=np.int64)
        self.number[order] = np.cumsum(head) - 1


def _totals(keys: np.ndarray, counts: np.ndarray) -> list[int]:
    """Training tokens, distinct ones, and training texts."""
    words = (keys & _TAG) == 0
    ends = words & (keys == (_END & ~np.uint64(3)))
    return [int(counts[words].sum()), int((counts[words] > 0).sum()), int(counts[ends].sum())]


class Automaton:
    """The part of the model that a block's texts can reach: weights by local numbers.

    The state after a token is the token's own, so all steps of a text are known at once and
    a whole block is read in one pass over its tokens.
    """

    def __init__(self, counts: np.ndarray, n_all: int, n_distinct: int, n_texts: int, pull: float) -> None:
        self.pull = pull
        self.p = (counts + 0.5) / (n_all + 0.5 * (n_distinct + 1))
        self.root = np.log10(self.p)
        #: by state; the last is the start of a text
        self.mass = np.append(counts, n_texts) + pull
        self.fail = math.log10(pull) - np.log10(self.mass)

    def read(self, token: np.ndarray, state: np.ndarray, together: np.ndarray) -> np.ndarray:
        """Weight of each step: from ``state`` by ``token``, ``together`` counted in training."""
        weight = self.fail[state] + self.root[token]
        arc = np.flatnonzero(together > 0)
        weight[arc] = np.log10((together[arc] + self.pull * self.p[token[arc]]) / self.mass[state[arc]])
        return weight


def score(docs: DataFrame, keep: Iterable[str] = ("doc_id",), learn: Column | None = None, pull: float = PULL) -> DataFrame:
    """``doc`` (a struct of ``keep``), n_tokens, n_known, train_tokens, base_score and score.

    ``learn`` says which documents teach the model; all do by default.
    """
    taught = F.coalesce(learn, F.lit(False)) if learn is not None else F.lit(True)
    table = exchange.blocks(docs, keep, "lm_blocks", {"learn": taught})
    buckets = exchange.bucket_count(table, 0.15)
    answers = exchange.answer(exchange.send(table, lambda block: _Tokens(block).counts(), buckets), "lm_counts", totals=_totals)
    parts = answers.where("block = -1").select("values").mapInArrow(_added, "n long, v long, d long")
    n_all, n_distinct, n_texts = (int(x or 0) for x in parts.agg(F.sum("n"), F.sum("v"), F.sum("d")).first())
    names = ("n_tokens", "n_known", "train_tokens")
    fields = [T.StructField("doc", table.schema["doc"].dataType), *(T.StructField(c, T.LongType()) for c in names)]
    fields += [T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())]

    def walked(block: pa.Table, told: pa.Table) -> pa.Table:
        tokens = _Tokens(block)
        words, pairs = _Numbered(tokens.words, tokens.learn), _Numbered(tokens.pairs, tokens.learn)
        known, news = exchange.heard(told)
        tag = (known & _TAG) == 0
        c = exchange.replaced(words.keys, words.own, known[tag], news[tag]).astype(np.float64)
        together = exchange.replaced(pairs.keys, pairs.own, known[~tag], news[~tag]).astype(np.float64)
        number = words.number
        state = np.empty_like(number)
        state[1:] = number[:-1]
        state[tokens.first[:-1]] = c.size
        model = Automaton(c, n_all, n_distinct, n_texts, pull)
        scores = row_sums(model.read(number, state, together[pairs.number]), tokens.first)
        n = len(scores)
        return pa.table(
            [
                block.column("doc"),
                pa.array(np.diff(tokens.first)),
                pa.array(row_sums((c[number] > 0).astype(np.int8), tokens.first)),
                pa.array(np.full(n, n_all, dtype=np.int64)),
                pa.array(row_sums(model.root[number], tokens.first)),
                pa.array(scores),
            ],
            names=[f.name for f in fields],
        )

    return exchange.meet(table, answers, walked, T.StructType(fields))


def _added(batches):
    total = np.zeros(3, dtype=np.int64)
    for batch in batches:
        for body in batch.column(0).to_pylist():
            total += exchange.unpack(body).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in total], names=["n", "v", "d"])
