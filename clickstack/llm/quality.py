"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed features: each word, the character
n-grams of the word between boundary marks, one mark for a word that repeats its predecessor, and
one mark for the end of the text. A softmax layer sits on the average. Vectors and softmax are
trained together by stochastic gradient descent in numpy on a bounded sample of labelled rows.

The softmax input is linear in the average, so at scoring time every word contributes a fixed number
(the summed projection of its vectors); tasks look words up instead of building vectors. Scoring is
one pass over the texts without a shuffle.
"""

from __future__ import annotations

import operator
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
BUCKETS = 1 << 16
DIM = 8
#: Lengths of the character n-grams, in UTF-8 bytes.
NGRAMS = (2, 3)
#: Words a task remembers before it starts afresh (it holds 500 texts' words besides).
MEMORY = 200_000
END, SAME = "\x00end", "\x00same"


def features(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every feature: the word itself and its n-grams between boundary marks."""
    marked = Words([f"<{w}>".encode("utf-8", "surrogatepass") for w in words])
    return joined([marked.whole(1, buckets), *(marked.ngrams(n, n, buckets) for n in NGRAMS)])


def _bags(texts: list[str], buckets: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct feature buckets and their shares, per text."""
    vocab: dict[str, int] = {}
    bags = []
    for text in texts:
        words = text.split()
        words += [SAME] * sum(map(operator.eq, words, words[1:])) + [END]
        bags.append(np.unique([vocab.setdefault(w, len(vocab)) for w in words], return_counts=True))
    owner, bucket = features(list(vocab), buckets)
    sizes = np.bincount(owner, minlength=len(vocab))
    starts = np.cumsum(sizes) - sizes
    ids, shares = [], []
    for types, counts in bags:
        n = sizes[types]
        at = np.repeat(starts[types] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        u, where = np.unique(bucket[at], return_inverse=True)
        c = np.bincount(where, np.repeat(counts, n))
        ids.append(u)
        shares.append(c / c.sum())
    return ids, shares


class SubwordModel:
    """Vectors (buckets x dim) and softmax weights (dim x 2)."""

    def __init__(self, vectors: np.ndarray, softmax: np.ndarray):
        self.vectors, self.softmax = vectors, softmax

    @classmethod
    def fit(cls, sample: list[tuple[str, int]], buckets: int = BUCKETS, dim: int = DIM, epochs: int = 8,
            rate: float = 0.5, seed: int = 7) -> "SubwordModel":
        rng = np.random.default_rng(seed)
        vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim))
        softmax = rng.uniform(-1 / dim, 1 / dim, (dim, 2))
        ids, shares = _bags([t for t, _ in sample], buckets)
        labels = [y for _, y in sample]
        steps, done = max(1, epochs * len(sample)), 0
        # AdaGrad scaling: a feature seen in few texts still moves as far as a common one.
        seen_v, seen_s = np.full(buckets, 1e-3), 1e-3
        for _ in range(epochs if sample else 0):
            for i in rng.permutation(len(sample)):
                pace = rate * (1 - done / steps)
                done += 1
                u, share = ids[i], shares[i]
                hidden = share @ vectors[u]
                z = hidden @ softmax
                p = np.exp(z - z.max())
                p /= p.sum()
                p[labels[i]] -= 1
                grad_h = softmax @ p
                grad_s = np.outer(hidden, p)
                seen_s += float((grad_s**2).mean())
                softmax -= pace / np.sqrt(seen_s) * grad_s
                seen_v[u] += (share**2) * float(grad_h @ grad_h) / dim
                vectors[u] -= (pace / np.sqrt(seen_v[u]) * share)[:, None] * grad_h
        return cls(vectors, softmax)

    def projection(self) -> np.ndarray:
        """Per bucket, what it adds to the log-odds of label 1 before averaging."""
        return self.vectors @ (self.softmax[:, 1] - self.softmax[:, 0])


def fit_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = MAX_TRAIN_ROWS,
                max_chars: int = MAX_TRAIN_CHARS) -> SubwordModel:
    """A model from at most ``max_rows`` labelled rows that are not held out."""
    return SubwordModel.fit(training_sample(docs, labels, label_col, max_rows, max_chars))


def _scorer(docs: DataFrame, model: SubwordModel):
    """A function from texts to scores, for use inside tasks."""
    weights = model.projection().astype(np.float64)
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 64 Ki numbers, whatever the input

    def scorer():
        table = shared.value
        memory: dict[str, complex] = {}

        def learn(words):
            # Real part: summed weights of the word's features. Imaginary part: their number.
            fresh = [w for w in words if w not in memory]
            if len(memory) + len(fresh) > MEMORY:
                memory.clear()
                fresh = [*words, END, SAME]
            owner, bucket = features(fresh, len(table))
            n = len(fresh)
            sums = np.bincount(owner, table[bucket], n) + 1j * np.bincount(owner, minlength=n)
            memory.update(zip(fresh, sums.tolist()))

        learn([END, SAME])

        def score(texts: pa.Array) -> np.ndarray:
            scores = []
            for at in range(0, len(texts), 500):
                held = [(t.as_py() or "").split() for t in texts[at : at + 500]]
                learn(set(chain.from_iterable(held)))
                end, same, look = memory[END], memory[SAME], memory.__getitem__
                for words in held:
                    total = sum(map(look, words), end) + same * sum(map(operator.eq, words, words[1:]))
                    scores.append(total.real / total.imag)
            return 1 / (1 + np.exp(-np.array(scores, np.float64)))

        return score

    return scorer


def score_quality(docs: DataFrame, model: SubwordModel, id_col: str = "doc_id", text_col: str = "text",
                  threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted``, one row per input row.

    ``score`` is the softmax probability of label 1 in [0, 1]; ``predicted`` is 1 from ``threshold``
    on. Null texts count as empty; empty texts get the score of the end mark alone. Very long texts
    are scored whole. Repeated rows score alike; an empty table gives an empty result. Only the
    id and the text are read."""
    scorer = _scorer(docs, model)

    def run(batches):
        score = scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score(batch.column(1)), pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col)).mapInArrow(
        run, "doc_id long, score double")
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, model: SubwordModel, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, all columns as they are, without a join."""
    scorer, place = _scorer(docs, model), docs.columns.index(text_col)

    def run(batches):
        score = scorer()
        for batch in batches:
            yield batch.filter(pa.array(score(batch.column(place)) >= threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


ship_by_value(__name__)
