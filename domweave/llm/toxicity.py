"""Toxicity by a support vector machine over a gapped string kernel with Nyström landmarks."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domweave.llm.common import releasing, utf8, worker_keeps

LETTERS = 26
#: The kernel compares runs of three letters that lie within SPAN places; each place costs a factor of DECAY.
SPAN, DECAY = 6, 0.7
_CODE = np.full(256, LETTERS, np.int64)
for _c in range(26):
    _CODE[65 + _c] = _CODE[97 + _c] = _c
_STEPS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
_FEATURES = LETTERS**3
_SPACED = re.compile(rb"(?<!\S)(?:[A-Za-z][\s._*-]+){2,}[A-Za-z](?![^\s.,;:!?])")


def terms(text: bytes) -> list[bytes]:
    """The distinct words of a text in lower case, and single letters in a row joined to one word."""
    found = set(text.lower().split())
    for spaced in _SPACED.findall(text):
        found.add(re.sub(rb"[^a-z]", b"", spaced.lower()))
    return list(found)


def _features(words: list[bytes]):
    """Normalised subsequence features of all words together: word, three letters as one number, value."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    codes = _CODE[np.frombuffer(b"".join(words), np.uint8)]
    owner = np.repeat(np.arange(len(words)), length)
    keys, values = [np.zeros(0, np.int64)], [np.zeros(0)]
    for a, b in _STEPS:
        if len(codes) <= b:
            continue
        n = len(codes) - b
        first, second, third = codes[:n], codes[a : a + n], codes[b:]
        at = np.flatnonzero((owner[:n] == owner[b:]) & (first < LETTERS) & (second < LETTERS) & (third < LETTERS))
        keys.append(((owner[at] * LETTERS + first[at]) * LETTERS + second[at]) * LETTERS + third[at])
        values.append(np.full(len(at), DECAY ** (b + 1)))
    key, value = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    value = np.add.reduceat(value, start) if len(key) else value
    word, feature = np.divmod(key[start], _FEATURES)
    norm = np.sqrt(np.bincount(word, weights=value**2, minlength=len(words)))
    return word, feature, value / norm[word]


def weighed(words: list[bytes], beta: np.ndarray, chunk: int = 20_000) -> np.ndarray:
    """Kernel expansion of every word: the landmarks are folded into one weight per subsequence."""
    out = []
    for i in range(0, len(words), chunk):
        part = words[i : i + chunk]
        word, feature, value = _features(part)
        out.append(np.bincount(word, weights=beta[feature] * value, minlength=len(part)))
    return np.concatenate(out) if out else np.zeros(0)


def subsequences(words: list[bytes]) -> np.ndarray:
    """Feature vectors of a few words."""
    word, feature, value = _features(words)
    out = np.zeros((len(words), _FEATURES), np.float32)
    out[word, feature] = value
    return out


@dataclass
class Model:
    """margin of a word: weighed(word, beta); of a document: its largest one; probability: logistic of a * margin + b."""

    beta: np.ndarray
    a: float
    b: float


def held_out(doc_id: Column | str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and intercept by Newton steps, with a small ridge."""
    X, w = np.c_[x, np.ones(len(x))], np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -30, 30)))
        step = np.linalg.solve(X.T @ (X * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), X.T @ (y - p) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit(texts: list[bytes], labels: list[int], landmarks: int = 160, instances: int = 3000, cost: float = 4.0, epochs: int = 40,
        seed: int = 7) -> Model:
    """A model from labelled texts (``fit_terms``)."""
    return fit_terms([terms(t) for t in texts], labels, landmarks, instances, cost, epochs, seed)


def fit_terms(documents: list[list[bytes]], labels: list[int], landmarks: int = 160, instances: int = 3000, cost: float = 4.0, epochs: int = 40,
              seed: int = 7) -> Model:
    """A model from the distinct terms of labelled texts.

    Words (the shortest sentences a label can be passed to) are the instances.  A word that
    toxic texts hold far more often than their share is positive, weighted by how often; words of
    other texts are negative.  Landmarks are the weightiest positive words and negatives spread
    over the alphabet; the Nyström map takes a word to K^(-1/2) of its kernels with them; a linear
    machine with hinge loss is trained there by averaged subgradient steps.
    """
    labels = np.array(labels, float)
    if len(labels) == 0 or labels.min() == labels.max():
        rate = labels.mean() if len(labels) else 0.0
        return Model(np.zeros(_FEATURES, np.float32), 0.0, 4.0 if rate > 0.5 else -4.0)
    counts: dict[bytes, list[int]] = {}
    for own, y in zip(documents, labels):
        for word in own:
            counts.setdefault(re.sub(rb"[^a-z]", b"", word), [0, 0])[int(y)] += 1
    counts.pop(b"", None)
    toxic, clean = labels.sum(), len(labels) - labels.sum()
    excess = {w: t / toxic - c / clean for w, (c, t) in counts.items() if len(w) >= 3}
    positive = sorted((w for w, x in excess.items() if counts[w][1] >= 3 and x > max(3 / toxic, 4 * counts[w][0] / clean)),
                      key=lambda w: (-excess[w], w))
    negative = sorted((w for w, (c, t) in counts.items() if len(w) >= 3 and c and t * clean <= 2 * c * toxic),
                      key=lambda w: (-counts[w][0], w))
    positive = positive[: instances // 4]
    if not positive or not negative:
        return Model(np.zeros(_FEATURES, np.float32), 0.0, float(np.log(toxic / clean)))
    # frequent words, and an even spread over all others
    rest = sorted(negative[instances // 4 :])
    negative = negative[: instances // 4] + rest[:: max(1, len(rest) // (instances // 2))]
    chosen = positive[: landmarks // 2] + negative[:: max(1, len(negative) // (landmarks // 2))][: landmarks // 2]
    marks = subsequences(chosen).astype(np.float64)
    values, vectors = np.linalg.eigh(marks @ marks.T)
    kept = values > 1e-6 * values.max()
    root = vectors[:, kept] / np.sqrt(values[kept])
    words = positive + negative
    X = np.concatenate([subsequences(words[i : i + 256]) @ marks.T for i in range(0, len(words), 256)]) @ root
    y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
    importance = np.r_[[excess[w] for w in positive], np.ones(len(negative))]
    importance[: len(positive)] *= len(negative) / importance[: len(positive)].sum()
    importance = np.minimum(importance, 40)
    random, w, mean, step, lam = np.random.default_rng(seed), np.zeros(X.shape[1] + 1), 0, 0, 1 / (cost * len(words))
    Xb = np.c_[X, np.full(len(X), 0.5)]
    for _ in range(epochs):
        for block in np.array_split(random.permutation(len(words)), max(1, len(words) // 32)):
            step += 1
            inside = y[block] * (Xb[block] @ w) < 1
            gradient = lam * w - ((importance[block] * y[block] * inside)[:, None] * Xb[block]).mean(0)
            w = w - gradient / (lam * (step + 200))
            mean = mean + (w - mean) / step if step > 100 else w
    beta = (marks.T @ (root @ mean[:-1])).astype(np.float32)
    margins = np.array([document_margin(own, beta, {}) for own in documents])
    a, b = _logistic(margins, labels)
    return Model(beta, a, b)


def document_margin(own: list[bytes], beta: np.ndarray, known: dict[bytes, float]) -> float:
    """Largest margin of a word; -1 without words."""
    new = [w for w in own if w not in known]
    if new:
        known.update(zip(new, weighed(new, beta).tolist()))
    return max(map(known.__getitem__, own), default=-1.0)


def train(docs: DataFrame, labels: DataFrame, sample: int = 3000, id_col: str = "doc_id", text: str = "text",
          target: str = "toxic", **options) -> Model:
    """A model from at most ``sample`` labelled documents that are not held out.

    The sample is bounded so that it fits the driver: as many toxic as other documents, by a hash of
    the id, with a stratum filled up if the other is short.  The distinct terms of a whole training text are
    found inside Spark, and only they reach the driver.  Labels come only from rows that are not held out.
    """
    def distinct_terms(batches):
        for batch in batches:
            own = [b"\n".join(terms(t)) for t in batch.column(2).to_pylist()]  # no term holds a blank
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.binary())], names=["doc_id", "y", "terms"])

    known = labels.select(F.col(id_col).alias("doc_id"), F.col(target).cast("int").alias("y")).where(
        F.col("y").isin(0, 1) & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("y").alias("y"))
    mine = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).where(~held_out("doc_id"))
    key = F.xxhash64("doc_id")
    parts = []
    for y in (0, 1):
        ids = known.where(F.col("y") == y).join(mine.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(key, "doc_id").limit(sample // 2)
        parts.append(ids)
    chosen = F.broadcast(parts[0].union(parts[1]))
    rows = mine.join(chosen, "doc_id").dropDuplicates(["doc_id"]).select(
        "doc_id", "y", utf8("text").alias("text")).mapInArrow(distinct_terms, "doc_id long, y int, terms binary").orderBy("doc_id").collect()
    return fit_terms([bytes(r.terms).split() for r in rows], [r.y for r in rows], **options)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", remember: int = 200_000) -> DataFrame:
    """doc_id, held_out, score of every whole text; map-only, the model is a few tens of kB.

    Empty and null texts are scored as texts without a toxic word.  Repeated rows give
    repeated results; null ids stay; other columns are ignored; an empty table gives no rows.
    """
    @releasing
    def rate(batches):
        worker_keeps("toxicity")
        known: dict[bytes, float] = {}
        for batch in batches:
            margins = []
            for value in batch.column(1).to_pylist():
                if len(known) > remember:
                    known.clear()
                margins.append(document_margin(terms(value), model.beta, known))
            p = 1 / (1 + np.exp(-np.clip(model.a * np.array(margins) + model.b, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], names=["doc_id", "score"])

    rated = docs.select(F.col(id_col).alias("doc_id"), utf8(text).alias("text")).mapInArrow(rate, "doc_id long, score double")
    return rated.select("doc_id", held_out("doc_id").alias("held_out"), "score")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows whose score is below ``threshold``, with all their columns, in one pass over the table."""
    @releasing
    def keep(batches):
        worker_keeps("toxicity")
        known: dict[bytes, float] = {}
        for batch in batches:
            kept = []
            for value in batch.column(text).cast(pa.binary()).to_pylist():
                if len(known) > 200_000:
                    known.clear()
                margin = document_margin(terms(value or b""), model.beta, known)
                kept.append(bool(1 / (1 + np.exp(-np.clip(model.a * margin + model.b, -30, 30))) < threshold))
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
