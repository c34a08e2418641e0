"""Toxicity classifier: subword-bag embeddings averaged into a linear softmax.

Words are runs of letters and digits of the lower-cased text; a word's subwords
are its character n-grams of ``NGRAMS`` with boundary marks, hashed into
``BUCKETS`` rows of an embedding. A window of ``WINDOW`` words is the mean of its
words' subword vectors, and a linear softmax gives its class. Embedding and
softmax are trained jointly in numpy. Words that were never seen share n-grams,
and so vectors, with those that were: misspellings and new compounds too.

Labels are given for whole documents, while a toxic document may have one toxic
word in thousands, and a clean one may have one word that looks like them. So a
document is judged by its strongest windows: the logits of the first, second,
third and sixth strongest (``POOLS``), squashed, go into a logistic function. In
training random windows of toxic documents start as toxic; then the strongest
windows of each are taken, against random and the strongest windows of clean
documents. The logistic function is fitted on sampled documents that the
embedding was not trained on.

The model is fitted to a bounded sample: ``SAMPLE`` labelled rows that are not
held out, of each at most ``SAMPLE_CHARS`` characters; a longer text is sampled
as pieces of ``SAMPLE_PIECE`` characters from all over it, chosen by a hash of
their position. Every whole text is scored. Labels, lang, source and doc_id are
never inputs of a score.

As mean and softmax are linear, a trained model is one number a bucket: it goes
to the workers with the function (half a megabyte), and each worker keeps the
scores of recent words in a table of bounded size. The driver holds the sampled
texts and the subwords of the words in one round's windows.

Defined cases: null and empty texts, and texts without words, get the score of
one window of weight 0. Without labelled rows of both classes the score is the
label share (0 without labels). Null ids are not held out. Repeated rows are
scored as rows; of several texts with one sampled id the one with the smallest
hash is fitted. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, on_workers, text_of
from .labelled import held_out, sample_documents, sample_labels

NGRAMS, BUCKETS, DIM, WINDOW, POOLS, SQUASH = (3, 4, 5, 6, 7, 8), 1 << 17, 8, 1, (1, 2, 3, 6), 12.0
SAMPLE, SAMPLE_CHARS, THRESHOLD, SAMPLE_PIECE, CLEAN_PER_TOXIC, FEW, CACHE_WORDS = 6_000, 16_384, 0.5, 512, 6, 40, 400_000
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word index, bucket) of every n-gram of ``<word>``."""
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), lens)
    end = np.repeat(np.cumsum(lens), lens)
    owners, buckets = [], []
    for n in NGRAMS:
        at = np.flatnonzero(np.arange(len(codes)) + n <= end)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = (h ^ codes[at + k]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
        owners.append(word[at])
        buckets.append(((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(47)).astype(np.int64) % BUCKETS)
    return np.concatenate(owners), np.concatenate(buckets)


def word_means(words: list[str], table: np.ndarray) -> np.ndarray:
    """Mean of each word's entries of ``table``, a number a bucket."""
    owner, bucket = subwords(words)
    n = np.maximum(np.bincount(owner, minlength=len(words)), 1)
    return np.bincount(owner, table[bucket], len(words)) / n


def window_means(scores: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Means over every run of ``window`` words; of all words where there are fewer."""
    if window == 1 and len(scores):
        return scores
    if len(scores) <= window:
        return np.asarray([scores.mean() if len(scores) else 0.0])
    total = np.concatenate([[0.0], np.cumsum(scores)])
    return (total[window:] - total[:-window]) / window


def strongest(logits: np.ndarray, pools: tuple[int, ...]) -> list[float]:
    """The k-th strongest window's logit for each k of ``pools``, the weakest where there are fewer; squashed to (-1, 1)."""
    most = max(pools)
    top = np.sort(logits if len(logits) <= most else np.partition(logits, -most)[-most:])[::-1]
    return [float(np.tanh(top[min(k, len(top)) - 1] / SQUASH)) for k in pools]


@dataclass
class ToxicModel:
    table: np.ndarray  # a bucket's logit difference: embedding times softmax weights
    bias: float
    slopes: list[float]  # of the pooled logits
    shift: float

    def probability(self, pooled) -> np.ndarray:
        z = np.asarray(pooled, float).reshape(-1, len(self.slopes)) @ np.asarray(self.slopes) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Scorer:
    """Strongest windows of texts, with a bounded table of word scores."""

    def __init__(self, table: np.ndarray, bias: float = 0.0):
        self.table, self.bias, self.known = table, bias, {}

    def word_scores(self, words: np.ndarray) -> np.ndarray:
        return np.concatenate([word_means(words[at : at + 20_000].tolist(), self.table) for at in range(0, len(words), 20_000)])

    def pooled(self, texts: list[str]) -> np.ndarray:
        """Pooled logits of each text: a row a text, a column for each of ``POOLS``."""
        lists = [words_of(t) for t in texts]
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        missing = list({w for ws in lists for w in ws if w not in known})
        for at in range(0, len(missing), 20_000):
            part = missing[at : at + 20_000]
            known.update(zip(part, word_means(part, self.table).tolist(), strict=True))
        get = known.__getitem__
        return np.asarray([strongest(window_means(np.fromiter(map(get, ws), np.float64, len(ws))) + self.bias, POOLS) for ws in lists]).reshape(-1, len(POOLS))


class _Bags:
    """Subwords of some words, laid out for sums by word and by bucket."""

    def __init__(self, words: list[str]):
        owner, bucket = subwords(words)
        order = np.argsort(owner, kind="stable")
        self.bucket, counts = bucket[order].astype(np.int32), np.bincount(owner, minlength=len(words))
        self.start, self.n = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64), np.maximum(counts, 1).astype(np.float32)
        self.owner = owner[order].astype(np.int32)
        self.by_bucket = np.argsort(self.bucket, kind="stable").astype(np.int32)
        self.slots, self.slot_start = np.unique(self.bucket[self.by_bucket], return_index=True)

    def means(self, table: np.ndarray) -> np.ndarray:
        """Mean row of ``table`` of each word, some thousand words at a time."""
        out = np.empty((len(self.start), table.shape[1]), np.float32)
        for at in range(0, len(self.start), 8192):
            start = self.start[at : at + 8192]
            end = self.start[at + 8192] if at + 8192 < len(self.start) else len(self.bucket)
            out[at : at + 8192] = np.add.reduceat(table[self.bucket[start[0] : end]], start - start[0], axis=0)
        return out / self.n[:, None]

    def scatter(self, grad: np.ndarray) -> np.ndarray:
        """Gradient of each bucket in ``slots`` from the gradients of the words' means."""
        g = grad / self.n[:, None]
        out = np.empty((len(self.slots), grad.shape[1]), np.float32)
        for at in range(0, len(self.slots), 8192):
            start = self.slot_start[at : at + 8192]
            end = self.slot_start[at + 8192] if at + 8192 < len(self.slots) else len(self.by_bucket)
            out[at : at + 8192] = np.add.reduceat(g[self.owner[self.by_bucket[start[0] : end]]], start - start[0], axis=0)
        return out


class _Trainer:
    """Joint training of embedding and softmax over windows of words."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.e = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.w = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
        self.b = np.zeros(2, np.float32)
        self.seen = np.zeros(BUCKETS, bool)
        self.state = [[np.zeros_like(p), np.zeros_like(p)] for p in (self.e, self.w, self.b)]
        self.t = 0

    def step(self, bags: _Bags, windows: np.ndarray, y: np.ndarray, weight: np.ndarray, rate: float, decay: float) -> None:
        x = bags.means(self.e)[windows].mean(axis=1)
        z = x @ self.w + self.b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        g = p * (weight / weight.sum())[:, None]
        gx = (g @ self.w.T) / windows.shape[1]
        gv = np.stack([np.bincount(windows.ravel(), np.repeat(gx[:, d], windows.shape[1]), len(bags.n)) for d in range(DIM)], axis=1).astype(np.float32)
        self.seen[bags.slots] = True
        self.t += 1
        for p_, at, grad, (m, s) in zip((self.e, self.w, self.b), (bags.slots, slice(None), slice(None)), (bags.scatter(gv), x.T @ g, g.sum(axis=0)), self.state, strict=True):
            m[at] += 0.1 * (grad - m[at])
            s[at] += 0.01 * (grad * grad - s[at])
            p_[at] -= rate * (m[at] / (1 - 0.9**self.t)) / (np.sqrt(s[at] / (1 - 0.99**self.t)) + 1e-8) + (rate * decay * p_[at] if p_.ndim == 2 else 0)

    def table(self) -> np.ndarray:
        """A bucket's logit difference; buckets that no window had stay 0."""
        return np.where(self.seen, self.e @ (self.w[:, 1] - self.w[:, 0]), 0).astype(np.float32)

    def bias(self) -> float:
        return float(self.b[1] - self.b[0])


def _embed(texts: list[str], y: np.ndarray, seed: int, rounds: int, steps: int) -> tuple[np.ndarray, float]:
    """(table, bias) from documents of both classes."""
    rng = np.random.default_rng(seed)
    ids: dict[str, int] = {}
    docs = [np.fromiter((ids.setdefault(w, len(ids)) for w in words_of(t)), np.int32) for t in texts]
    vocabulary = np.asarray(list(ids), object)
    del ids
    trainer = _Trainer(seed)
    runs = {i: np.lib.stride_tricks.sliding_window_view(d, WINDOW) if len(d) >= WINDOW else np.resize(d, (1, WINDOW)) for i, d in enumerate(docs) if len(d)}
    toxic, clean = [i for i in runs if y[i]], [i for i in runs if not y[i]]
    if not toxic or not clean:
        return trainer.table(), 0.0

    def pick(i, k):
        return runs[i][rng.integers(0, len(runs[i]), min(k, len(runs[i])))]

    for turn in range(rounds):
        score = Scorer(trainer.table()).word_scores(vocabulary) if turn else None
        strong = lambda i, k: runs[i][np.argsort(-score[runs[i]].mean(axis=1), kind="stable")[:k]]
        pos = np.concatenate([strong(i, 3 if turn == 1 else 2) if turn else pick(i, 200) for i in toxic])
        per = max(4, min(64, 200_000 // max(1, len(clean))))
        neg = np.concatenate([np.concatenate([pick(i, per)] + ([strong(i, 3)] if turn else [])) for i in clean])
        windows, target = np.concatenate([pos, neg]), np.concatenate([np.ones(len(pos), int), np.zeros(len(neg), int)])
        weight = np.where(target == 1, len(neg) / len(pos), 1.0)
        used, local = np.unique(windows, return_inverse=True)
        bags = _Bags(vocabulary[used].tolist())
        for _ in range(steps):
            trainer.step(bags, local.reshape(windows.shape), target, weight, 0.05, 0.002)
        del bags
    return trainer.table(), trainer.bias()


def fit(texts: list[str], labels: list[int], seed: int = 5, rounds: int = 4, steps: int = 12) -> ToxicModel:
    y = np.asarray(labels, int)
    if len(y) == 0 or y.min() == y.max():
        p = min(max(float(y.mean()) if len(y) else 0.0, 1e-6), 1 - 1e-6)
        return ToxicModel(np.zeros(BUCKETS, np.float32), 0.0, [0.0] * len(POOLS), float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    some = lambda mask: [t for t, k in zip(texts, mask, strict=True) if k]
    # clean documents in the embedding: a few for each toxic one
    ratio = min(1.0, CLEAN_PER_TOXIC * y.sum() / (len(y) - y.sum()))
    if y.sum() >= FEW:  # trained on most of them; the others scale the score
        own = rng.random(len(y)) < np.where(y == 1, 0.8, 0.8 * ratio)
        table, bias = _embed(some(own), y[own], seed, rounds, steps)
        slopes, shift = _scale(Scorer(table, bias).pooled(some(~own)), y[~own])
        return ToxicModel(table, bias, slopes, shift)
    # too few toxic ones to set some aside: halves scale each other, and the embedding has them all
    half = np.zeros(len(y), int)
    for c in (0, 1):
        half[rng.permutation(np.flatnonzero(y == c))[: int((y == c).sum()) // 2]] = 1
    own = (y == 1) | (rng.random(len(y)) < ratio)
    x = np.zeros((len(y), len(POOLS)))
    for h in (0, 1):
        x[half == h] = Scorer(*_embed(some(own & (half != h)), y[own & (half != h)], seed, rounds, steps)).pooled(some(half == h))
    slopes, shift = _scale(x, y)
    table, bias = _embed(some(own), y[own], seed, rounds, steps)
    return ToxicModel(table, bias, slopes, shift)


def _scale(x: np.ndarray, y: np.ndarray) -> tuple[list[float], float]:
    """Logistic regression on the pooled logits, with smoothed targets (Platt) and a small ridge."""
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    mean, sd = x.mean(axis=0), x.std(axis=0) + 1e-9
    u = np.column_stack([(x - mean) / sd, np.ones(len(x))])
    w = np.zeros(u.shape[1])
    w[-1] = np.log((pos + 1) / (neg + 1))
    ridge = np.diag([0.1] * (len(w) - 1) + [1e-3])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(u @ w, -40, 40)))
        h = (u * (p * (1 - p) + 1e-6)[:, None]).T @ u + ridge
        w -= 0.5 * np.linalg.solve(h, u.T @ (p - target) + ridge @ (w * ([1.0] * (len(w) - 1) + [0.0])))
    return (w[:-1] / sd).tolist(), float(w[-1] - (w[:-1] * mean / sd).sum())


def _sampled(text: Column, chars: int, piece: int = SAMPLE_PIECE) -> Column:
    """The text, or of a longer one than ``chars`` pieces from all over it."""
    n = F.length(text)
    ranked = F.array_sort(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((n - 1) / piece).cast("int"))), lambda i: F.struct(F.xxhash64(i).alias("h"), i.alias("i"))))
    some = F.transform(F.slice(ranked, F.lit(1), F.lit(max(1, chars // piece))), lambda r: F.substring(text, r["i"] * piece + 1, F.lit(piece)))
    return F.when(n <= chars, text).otherwise(F.array_join(some, " "))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, chars: int = SAMPLE_CHARS) -> ToxicModel:
    chosen = sample_labels(labels, "toxic", rows).collect()  # at most `rows` ids
    got = sample_documents(docs, chosen, [_sampled(text_of(), chars).alias("text")]).orderBy("doc_id").collect()  # a row an id
    return fit([r.text for r in got], [r.y for r in got])


def probability(spark, model: ToxicModel) -> Column:
    """A pandas UDF of the text: the model's probability."""
    held: list[Scorer] = []

    @F.pandas_udf("double")
    def toxic(texts):
        import pandas as pd

        if not held:
            held.append(Scorer(model.table, model.bias))
        return pd.Series(model.probability(held[0].pooled(texts.tolist())))

    return toxic


def score_documents(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, threshold: float = THRESHOLD, model: ToxicModel | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    spark = docs.sparkSession
    model = model or train(docs, labels, rows)
    arrow_rows(spark)
    on_workers(spark)
    scored = docs.select("doc_id", probability(spark, model)(text_of()).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, model: ToxicModel | None = None) -> DataFrame:
    """The documents whose score is below ``threshold``, with all their columns; no shuffle."""
    spark = docs.sparkSession
    model = model or train(docs, labels)
    arrow_rows(spark)
    on_workers(spark)
    return docs.where(probability(spark, model)(text_of()) < threshold)
