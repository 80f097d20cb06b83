"""Toxic spans by a linear-chain conditional random field.

Tokens are tagged toxic or not. The labelled tokens come from labelled documents: a token of a toxic
document is marked when its word, or a prefix of it, is found in toxic documents far more often
than in clean ones; every token of a clean document is unmarked. The field has features of the token
(word, prefixes, suffix, shape) and a transition between neighbours, and is trained on a bounded
sample by the gradient that forward and backward passes give.

Forward-backward marginals of a document are aggregated into its score by a logistic layer over
the strongest marginal and the expected number of toxic tokens. Tokens with a marginal of at least
one half are the offending offsets. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

import re
import string
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickstack.llm.base import held_out, ship_by_value, text_of
from clickstack.llm.hashing import Words, joined
from clickstack.llm.labelled import training_sample

#: Training bounds: labelled rows, and code points of their texts together.
MAX_TRAIN_ROWS = 2400
MAX_TRAIN_CHARS = 4_000_000
BUCKETS = 1 << 18
#: Lengths of the prefixes, in UTF-8 bytes.
PREFIXES = (3, 4, 5, 6, 7, 8, 10)
#: Tokens whose passes are run together, and words a task remembers before it starts afresh.
TOKENS = 1 << 18
MEMORY = 400_000
PUNCTUATION = string.punctuation + "\u201c\u201d\u2018\u2019\u00ab\u00bb\u2026\u2013\u2014\u00a1\u00bf"


def clean(token: str) -> str:
    """The word without outer punctuation, in lower case."""
    return token.strip(PUNCTUATION).lower()


def features(tokens: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(token number, bucket) of every feature: word, prefixes, last letters, shape."""
    words = Words([clean(t).encode("utf-8", "surrogatepass") for t in tokens])
    shape = Words([b"%d%d" % (t.isupper(), t.isalpha()) for t in tokens])
    return joined([words.whole(1, buckets), words.suffixes(3, 2, buckets), shape.whole(3, buckets),
                   *(words.prefixes(n, 10 + n, buckets) for n in PREFIXES)])


def _fold(n: int) -> tuple[int, int]:
    width = max(1, int(np.sqrt(n)))
    return width, -(-n // width)


def _chain(emission: np.ndarray, first: np.ndarray, transition: np.ndarray, start: np.ndarray):
    """Forward and backward messages of many chains laid end to end.

    ``emission`` is each token's log-odds of the toxic state, ``first`` marks the first token of each
    chain. A chain's first matrix has equal rows, which makes it forget what came before, so one
    product over all tokens serves every chain. Rows of the folded token array advance together.
    """
    n = len(emission)
    width, rows = _fold(n)
    # Scaled so that the larger of both state weights is 1. Tokens past the end are identities.
    off, on = np.ones(rows * width), np.ones(rows * width)
    off[:n], on[:n] = np.exp(-np.maximum(emission, 0)), np.exp(np.minimum(emission, 0))
    m = np.empty((4, rows * width))  # entries 00, 01, 10, 11 of each token's matrix
    for e, (i, j) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1))):
        m[e] = transition[i, j] * (on if j else off)
        m[e, :n][first] = start[j] * (on if j else off)[:n][first]
        m[e, n:] = float(i == j)
    t = np.ascontiguousarray(m.reshape(4, rows, width).transpose(0, 2, 1))  # entry, column, row

    def product(a, b):
        c = np.stack([a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3],
                      a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3]])
        return c

    eye = np.repeat(np.array([[1.0], [0.0], [0.0], [1.0]]), rows, axis=1)
    ahead, back, run = np.empty_like(t), np.empty_like(t), eye
    for k in range(width):
        run = product(run, t[:, k])
        if k % 4 == 3:
            run /= run.sum(axis=0)
        ahead[:, k] = run
    run = eye
    for k in range(width - 1, -1, -1):  # product of the matrices after a token, up to the end of its row
        back[:, k] = run
        run = product(t[:, k], run)
        if k % 4 == 3:
            run /= run.sum(axis=0)
    into, out = np.empty((2, rows)), np.empty((2, rows))
    carry = (0.5, 0.5)
    last = ahead[:, -1].T.tolist()
    for r in range(rows):
        into[:, r] = carry
        p, q = carry[0] * last[r][0] + carry[1] * last[r][2], carry[0] * last[r][1] + carry[1] * last[r][3]
        carry = (p / (p + q), q / (p + q))
    carry, whole = (1.0, 1.0), run.T.tolist()
    for r in range(rows - 1, -1, -1):
        out[:, r] = carry
        p, q = whole[r][0] * carry[0] + whole[r][1] * carry[1], whole[r][2] * carry[0] + whole[r][3] * carry[1]
        carry = (p / (p + q), q / (p + q))
    flat = lambda x: x.T.reshape(-1)[:n]
    alpha = np.stack([flat(into[0] * ahead[0] + into[1] * ahead[2]), flat(into[0] * ahead[1] + into[1] * ahead[3])], 1)
    beta = np.stack([flat(back[0] * out[0] + back[1] * out[1]), flat(back[2] * out[0] + back[3] * out[1])], 1)
    return alpha, beta, m[:, :n].T.reshape(n, 2, 2)


def marginals(emission: np.ndarray, first: np.ndarray, transition: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Each token's probability of the toxic state."""
    if not len(emission):
        return np.zeros(0)
    alpha, beta, _ = _chain(emission, first, transition, start)
    both = alpha * beta
    return both[:, 1] / both.sum(axis=1)


def weak_token_labels(vocab: list[str], bags: list[np.ndarray], toxic: np.ndarray, ratio: float = 20.0) -> np.ndarray:
    """Which words of ``vocab`` mark toxicity: they, or one of their prefixes of at least four
    bytes, are ``ratio`` times as frequent among toxic documents as among clean ones. ``bags`` are
    the documents' distinct word numbers. A word or prefix must be found in so many toxic
    documents that chance would not bring about one such case among all words."""
    size = 1 << 22
    words = Words([clean(w).encode("utf-8", "surrogatepass") for w in vocab])
    owner, bucket = joined([words.whole(1, size), *(words.prefixes(n, 10 + n, size) for n in PREFIXES if n > 3)])
    sizes = np.bincount(owner, minlength=len(vocab))
    starts = np.cumsum(sizes) - sizes
    seen = np.zeros((2, size))
    for types, label in zip(bags, toxic):
        n = sizes[types]
        at = np.repeat(starts[types] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        seen[label][np.unique(bucket[at])] += 1
    n1, n0 = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    support = max(3.0, np.log(max(2, (seen.sum(axis=0) > 0).sum())) / np.log((n1 + n0) / n1))
    strong = (seen[1] >= support) & (seen[1] / n1 >= ratio * (seen[0] + 0.5) / n0)
    return np.bincount(owner, strong[bucket], len(vocab)) > 0


class ToxicField:
    """Emission weights by bucket, transition and start weights, and the logistic layer."""

    def __init__(self, weights, transition, start, layer):
        self.weights, self.transition, self.start, self.layer = weights, transition, start, layer

    @staticmethod
    def aggregates(p: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Per document: log-odds of the strongest marginal, log of the expected toxic tokens, 1."""
        top, total = np.zeros(n), np.zeros(n)
        np.maximum.at(top, owner, p)
        np.add.at(total, owner, p)
        top = np.clip(top, 1e-6, 1 - 1e-6)
        return np.stack([np.log(top / (1 - top)), np.log(total + 1e-3), np.ones(n)], axis=1)

    @classmethod
    def fit(cls, sample: list[tuple[str, int]], buckets: int = BUCKETS, rounds: int = 40, l2: float = 1e-7) -> "ToxicField":
        words = [t.split() for t, _ in sample]
        toxic = np.array([y for _, y in sample], np.int64)
        vocab: dict[str, int] = {}
        codes = np.array([vocab.setdefault(w, len(vocab)) for own in words for w in own], np.int64)
        sizes = np.array([len(own) for own in words], np.int64)
        owner = np.repeat(np.arange(len(sample)), sizes)
        first = np.zeros(len(codes), bool)
        first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        ends = np.cumsum(sizes)
        bags = [np.unique(codes[e - s : e]) for e, s in zip(ends, sizes)]
        is_marked = weak_token_labels(list(vocab), bags, toxic) if vocab else np.zeros(0, bool)
        gold = (is_marked[codes] & (toxic[owner] == 1)).astype(np.int64) if len(codes) else np.zeros(0, np.int64)
        type_of, flat = features(list(vocab), buckets) if vocab else (codes, codes)
        weights, move, bias = np.zeros(buckets), np.zeros((2, 2)), np.zeros(2)
        if not len(codes) or not gold.any() or not (toxic == 0).any():
            return cls(weights, np.full((2, 2), 0.5), np.array([0.5, 0.5]), np.array([0.0, 0.0, -2.0]))
        memory_w, memory_m, memory_b = np.full(buckets, 1e-8), np.full((2, 2), 1e-8), np.full(2, 1e-8)
        step, n = ~first, len(codes)
        pair_gold = np.zeros((2, 2))
        np.add.at(pair_gold, (gold[:-1][step[1:]], gold[1:][step[1:]]), 1)
        start_gold = np.bincount(gold[first], minlength=2).astype(float)
        token_gold = np.bincount(codes, gold, len(vocab))
        for k in range(rounds):
            types = np.bincount(type_of, weights[flat], len(vocab))
            # Row sums are free in a field: the scale of a matrix cancels in the marginals.
            alpha, beta, m = _chain(np.clip(types[codes], -30, 30), first, np.exp(move), np.exp(bias))
            both = alpha * beta
            p = both[:, 1] / both.sum(axis=1)
            pair = alpha[:-1, :, None] * m[1:] * beta[1:, None, :]
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            grad_m = (pair_gold - pair[step[1:]].sum(axis=0)) / n
            grad_b = (start_gold - np.stack([1 - p[first], p[first]], 1).sum(axis=0)) / n
            by_type = (token_gold - np.bincount(codes, p, len(vocab))) / n
            grad_w = np.bincount(flat, by_type[type_of], buckets) - l2 * weights
            for value, grad, memory in ((weights, grad_w, memory_w), (move, grad_m, memory_m), (bias, grad_b, memory_b)):
                memory += grad * grad
                value += 0.5 * grad / np.sqrt(memory)
        types = np.bincount(type_of, weights[flat], len(vocab))
        transition, start = np.exp(move - move.max()), np.exp(bias - bias.max())
        p = marginals(np.clip(types[codes], -30, 30), first, transition, start)
        x, layer = cls.aggregates(p, owner, len(sample)), np.zeros(3)
        for _ in range(25):  # Newton steps of a ridge logistic regression
            q = 1 / (1 + np.exp(-np.clip(x @ layer, -30, 30)))
            hess = (x * (q * (1 - q))[:, None]).T @ x + 1e-2 * np.eye(3)
            layer = layer + np.linalg.solve(hess, x.T @ (toxic - q) - 1e-2 * layer)
        return cls(weights, transition, start, layer)


def fit_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_rows: int = MAX_TRAIN_ROWS,
                 max_chars: int = MAX_TRAIN_CHARS) -> ToxicField:
    """A field from at most ``max_rows`` labelled rows that are not held out."""
    return ToxicField.fit(training_sample(docs, labels, label_col, max_rows, max_chars))


def score_toxicity(docs: DataFrame, field: ToxicField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted, spans``, one row per input row.

    ``score`` in [0, 1] is higher when label 1 is likelier; ``predicted`` is 1 from 0.5 on; ``spans``
    lists the offending tokens as code point offsets (start, end). Null texts count as empty; texts
    without tokens get the score of no toxic token and no spans. Very long texts are tagged whole.
    Repeated rows score alike; an empty table gives an empty result. Only the id and the text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(
        (field.weights.astype(np.float32), field.transition, field.start, field.layer))  # fixed size

    def run(batches):
        weights, transition, start, layer = shared.value
        memory: dict[str, float] = {}

        def learn(words):
            fresh = [w for w in words if w not in memory]
            if len(memory) + len(fresh) > MEMORY:
                memory.clear()
                fresh = list(words)
            if fresh:
                owner, bucket = features(fresh, len(weights))
                sums = np.clip(np.bincount(owner, weights[bucket], len(fresh)), -30, 30)
                memory.update(zip(fresh, sums.tolist()))

        def tag(texts):
            words = [t.split() for t in texts]
            sizes = np.array([len(w) for w in words], np.int64)
            n = int(sizes.sum())
            learn(set(chain.from_iterable(words)))
            emission = np.fromiter(map(memory.__getitem__, chain.from_iterable(words)), np.float64, n)
            first = np.zeros(n, bool)
            first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
            p = marginals(emission, first, transition, start)
            x = ToxicField.aggregates(p, np.repeat(np.arange(len(texts)), sizes), len(texts))
            scores = 1 / (1 + np.exp(-np.clip(x @ layer, -30, 30)))
            spans, ends = [], np.cumsum(sizes)
            for text, end, size in zip(texts, ends, sizes):
                hot = np.flatnonzero(p[end - size : end] >= 0.5)
                places = [m.span() for m in re.finditer(r"\S+", text)] if len(hot) else []
                spans.append([{"start": places[i][0], "end": places[i][1]} for i in hot])
            return scores, spans

        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            scores, spans, held, chars = [], [], [], 0
            texts = batch.column(1)
            for i in range(len(texts)):
                held.append(texts[i].as_py() or "")
                chars += len(held[-1])
                if chars >= 4 * TOKENS or i == len(texts) - 1:
                    s, sp = tag(held)
                    scores.append(s)
                    spans.extend(sp)
                    held, chars = [], 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(scores) if scores else np.zeros(0)), pa.array(spans, kind)],
                names=["doc_id", "score", "spans"])

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col)).mapInArrow(
        run, "doc_id long, score double, spans array<struct<start:int,end:int>>")
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


ship_by_value(__name__)
