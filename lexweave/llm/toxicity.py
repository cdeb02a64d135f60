"""Toxicity by multiple-instance learning: sentences are the instances, only documents have labels.

A sentence's logit is a bias plus the weights of its words; a word's weight is the sum of hashed features of the word and its
beginnings, so unseen inflections of a known stem still count. A document is toxic if any sentence is: noisy-or,
1 - prod(1 - p_sentence). The gradient of the document likelihood flows through the noisy-or to sentences, which is what lets
the model find the offending ones although it never saw a labelled sentence.

The classifier is fitted on a bounded sample: at most MAX_SAMPLE labelled documents, those whose hashed id is smallest, and of them no more than
MAX_SAMPLE_CHARS characters; a longer text than that isn't in it. Every document is scored whole.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, remainder, settle, texts_of, with_columns

#: Bound on the labelled documents that fit() gets, and on their characters; the latter thins the sample by hash.
MAX_SAMPLE, MAX_SAMPLE_CHARS = 10_000, 24_000_000
FEATURES = 1 << 18
PREFIXES = (3, 4, 5, 6)
#: A feature counts only if at least so many sampled documents have it, and so large a part of them.
MIN_DOCS, MIN_SHARE = 3, 1e-3
EPOCHS, RATE, SPARSITY = 120, 0.15, 1e-4
#: The bias before training: a long text of clean sentences must not add up to a toxic one.
START = -10.0
THRESHOLD = 0.3
#: Distinct words whose weight a worker remembers, and characters of them.
REMEMBERED, REMEMBERED_CHARS = 150_000, 16 << 20

sentence_end = re.compile(r"[.!?\n\r…。]+")
word_parts = re.compile(r"\w+").findall


def features(word: str) -> list[int]:
    """Hashed features of a lower-case word: itself and its beginnings."""
    names = [f"={word}", *(f"^{word[:n]}" for n in PREFIXES if len(word) >= n)]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % FEATURES for x in names]


def sentences(text: str) -> list[str]:
    """The text's sentences; a text without any counts as one empty sentence."""
    return [s for s in sentence_end.split(text) if s and not s.isspace()] or [""]


class Model:
    """weights by feature and the bias, as 32-bit floats: 1 MB whatever the corpus."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)
        self._words: dict[str, float] = {}
        self._size = 0

    def __reduce__(self):
        return Model, (self.weights, self.bias)

    def _weight(self, chunk: str) -> float:
        got = self._words.get(chunk)
        if got is None:
            if len(self._words) > REMEMBERED or self._size > REMEMBERED_CHARS:
                self._words.clear()
                self._size = 0
            self._size += len(chunk)
            got = self._words[chunk] = float(sum(self.weights[features(w)].sum(dtype=np.float64) for w in word_parts(chunk)))
        return got

    def logit(self, sentence: str) -> float:
        return self.bias + sum(map(self._weight, sentence.lower().split()))

    def score(self, text: str) -> float:
        """The noisy-or of the sentences' probabilities."""
        doubt = 0.0
        for s in sentences(text):
            z = self.logit(s)
            doubt += max(z, 0.0) + math.log1p(math.exp(-abs(z)))
        return -math.expm1(-doubt)

    def offending(self, text: str, threshold: float = THRESHOLD) -> list[dict]:
        """Spans (begin, end, probability) of the sentences whose own probability reaches the threshold."""
        found, at = [], 0
        for end in [m.span() for m in sentence_end.finditer(text)] + [(len(text), len(text))]:
            s = text[at : end[0]]
            p = 1 / (1 + math.exp(-max(-700.0, min(700.0, self.logit(s)))))
            if s and not s.isspace() and p >= threshold:
                found.append({"begin": at, "end": end[0], "probability": p})
            at = end[1]
        return found


def fit(texts: list[str], labels: list[int]) -> Model:
    """Maximise the documents' likelihood by Adam on the whole sample. One class alone, or nothing, gives a constant model.

    Weights are kept non-negative and sparse: a word can only add evidence, so ordinary words never outvote a toxic one in a sentence.
    """
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(FEATURES), 6.0 if len(y) and y.min() else -12.0)
    vocabulary: dict[str, int] = {}
    token, start, doc = array("i"), array("i"), array("i")
    for d, text in enumerate(texts):
        for s in sentences(text):
            if found := word_parts(s.lower()):
                start.append(len(token))
                doc.append(d)
                token.extend([vocabulary.setdefault(w, len(vocabulary)) for w in found])
    if not token:
        return Model(np.zeros(FEATURES), -12.0)
    token, start, doc = (np.array(x, np.int32) for x in (token, start, doc))
    n_words, row, col = len(vocabulary), array("i"), array("i")
    for i, w in enumerate(vocabulary):
        found = features(w)
        row.extend([i] * len(found))
        col.extend(found)
    del vocabulary
    row, col = np.array(row, np.int32), np.array(col, np.int32)
    # Words that occur in enough documents through a feature: others keep weight zero.
    pairs = np.unique(np.repeat(doc, np.diff(np.r_[start, len(token)])).astype(np.int64) * n_words + token)
    seen = np.bincount(col, weights=np.bincount(pairs % n_words, minlength=n_words)[row], minlength=FEATURES)
    use = seen[col] >= max(MIN_DOCS, MIN_SHARE * len(y))
    row, col = row[use], col[use]
    kept, col = np.unique(col, return_inverse=True)
    theta, bias = np.zeros(len(kept)), START
    moment, square = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    sizes = np.diff(np.r_[start, len(token)])
    for step in range(1, EPOCHS + 1):
        weight = np.bincount(row, weights=theta[col], minlength=n_words)
        z = bias + np.add.reduceat(weight[token], start)
        doubt = np.bincount(doc, weights=np.logaddexp(0, z), minlength=len(y)) + 1e-12
        pull = np.where(y > 0, -1 / np.expm1(np.minimum(doubt, 50)), 1.0)
        slope = np.clip(pull[doc], -1e4, 1) / (1 + np.exp(-np.clip(z, -50, 50)))
        by_word = np.bincount(token, weights=np.repeat(slope, sizes), minlength=n_words)
        grad = np.r_[np.bincount(col, weights=by_word[row], minlength=len(kept)) / len(y) + SPARSITY, slope.sum() / len(y)]
        moment = 0.9 * moment + 0.1 * grad
        square = 0.99 * square + 0.01 * grad * grad
        change = RATE * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
        theta, bias = np.maximum(0, theta - change[:-1]), bias - change[-1]
    weights = np.zeros(FEATURES)
    weights[kept] = theta
    return Model(weights, bias)


def training_sample(docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """At most MAX_SAMPLE labelled texts: (text, label). Of conflicting labels of an id the larger counts; null labels and ids don't."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    if learn is not None:
        known = known.where(learn)
    chosen = known.groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("_label")).orderBy(F.xxhash64(id_col), id_col).limit(MAX_SAMPLE)
    got = docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("_text")).join(F.broadcast(chosen), id_col)
    got = settle(got.select(F.xxhash64(id_col).alias("_order"), F.col("_text").alias("text"), F.col("_label").alias("label")), "toxicity-sample")
    got = got.where(F.length("text") <= MAX_SAMPLE_CHARS)
    size = got.agg(F.sum(F.length("text"))).first()[0] or 0
    share = min(1.0, MAX_SAMPLE_CHARS / max(1, size))
    return got.where(F.pmod(F.xxhash64("_order", F.lit(1)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy("_order", "text").limit(MAX_SAMPLE).select("text", "label")


def trained(sample: DataFrame) -> Model:
    """fit() on a bounded sample(text, label), in one task of an executor; the driver gets the weights alone."""
    import pickle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels = [], []
        for part in batches:
            texts += part.column("text").to_pylist()
            labels += part.column("label").to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts, labels))])], names=["model"])

    got = sample.coalesce(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(got[0][0]) if got else fit([], [])


def _unpickled(raw: bytes) -> Model:
    import pickle

    return kept(("toxicity", raw), lambda: pickle.loads(raw))


def scored(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, spans: bool = False) -> DataFrame:
    """docs (the columns in keep, all by default) with `score`, and with `offending` spans if asked for.

    A null text is an empty one; an empty text is one empty sentence and gets the bias alone. Rows pass through one by one, repeats included.
    An input column named score or offending is replaced.
    """
    import pickle

    raw = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def add(part: pa.RecordBatch) -> dict[str, pa.Array]:
        use, texts = _unpickled(raw.value), texts_of(part, text_col)
        got = {"score": pa.array([use.score(x) for x in texts], pa.float64())}
        if spans:
            kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))
            got["offending"] = pa.array([use.offending(x) for x in texts], kind)
        return got

    fields = "score double" + ", offending array<struct<begin:int,end:int,probability:double>>" * spans
    keep = docs.columns if keep is None else keep
    return with_columns(docs.select(*dict.fromkeys([*keep, text_col])), add, fields, keep)


def held_out(ident: Column) -> Column:
    return F.coalesce(remainder(ident, 4) == 2, F.lit(False))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    model = trained(training_sample(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"))))
    got = scored(docs, model, keep=["doc_id"])
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
