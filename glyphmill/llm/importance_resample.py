"""Quality classifier by importance resampling (operator 8).

Two generative models over hashed n-grams: the target model is fitted on a bounded sample of documents labelled good, the
raw model counts every document. A document's log ratio of the two, for each of its n-grams, is calibrated on the labelled
sample to log odds of being target text: n-grams aren't independent, so their plain sum would be overconfident by a factor
that grows with the length, and short documents would weigh nothing. The odds are the importance weights. Gumbel top-k with
noise of scale 1 on the log weights draws the sample without replacement, with probability in proportion to the weights.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm._common import hashed_order, materialise, slices, texts

#: Buckets of the hashed n-grams; three families (word unigrams, word bigrams, shape trigrams) share them.
BUCKETS = 1 << 14
#: Most labelled rows that the target model and the threshold are fitted on, the first in hashed order.
MAX_LABELLED = 20_000
SMOOTHING = 0.5
MEMO_WORDS = 400_000
#: Weight of the prior on the calibration's slope; the columns that scored rows carry.
PRIOR, WEIGHT, KEY = 0.01, "__gm_weight", "__gm_key"
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - 14)


def _shape(word: str) -> int:
    """A small number for the look of a word: case, edges, digits, length class. Plain words are told by two tests."""
    if word.isalpha() and len(word) <= 24:
        if word.islower():
            return 1
        return 2 if word[1:].islower() or len(word) == 1 else 3
    core = word.rstrip("".join(c for c in set(word) if not c.isalpha()))
    tail, last = len(word) - len(core), word[-1]
    upper = core.isupper() and len(core) > 1
    return hash_of(f"{upper}.{core[:1].isupper()}.{min(tail, 3)}.{'' if last.isalpha() else last}.{any(map(str.isdigit, word))}.{bool(core)}.{len(word) > 24}")


def hash_of(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 8)


class _Memo(dict):
    """word -> row of the tables of word hashes and shape hashes."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes = np.zeros(1 << 12, np.uint64)
        self.shapes = np.zeros(1 << 12, np.uint64)

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        if at >= len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
            self.shapes = np.concatenate([self.shapes, np.zeros_like(self.shapes)])
        self.hashes[at] = hash_of(word)
        self.shapes[at] = _shape(word)
        return at


class NGrams:
    """The buckets of texts' n-grams: words, pairs of words, and trigrams of shapes where a repeated word has a shape of its own."""

    def __init__(self) -> None:
        self._memo = _Memo()

    def __call__(self, batch: list[str]) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
        """(buckets, owner): the n-grams of all the texts, three for each word, and the text that each belongs to."""
        if len(self._memo) > MEMO_WORDS:
            self._memo = _Memo()
        row_of, parts, sizes = self._memo.__getitem__, [], []
        for text in batch:
            words = text.split()
            parts.append(np.fromiter(map(row_of, words), np.int64, len(words)))
            sizes.append(len(words))
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        hashes, shapes = self._memo.hashes[ids], self._memo.shapes[ids]
        begins = np.ones(len(ids), bool)
        begins[1:] = owner[1:] != owner[:-1]
        shapes[1:][(ids[1:] == ids[:-1]) & ~begins[1:]] = 77

        def before(values: np.ndarray) -> np.ndarray:
            out = np.zeros_like(values)
            out[1:] = values[:-1]
            out[begins] = 0
            return out

        once = before(shapes)
        pairs = (before(hashes) * _MULTIPLY) ^ hashes
        triples = (((before(once) * _MULTIPLY) ^ once) * _MULTIPLY) ^ shapes ^ np.uint64(3)
        return tuple(((x * _MULTIPLY) >> _SHIFT).astype(np.int32) for x in (hashes, pairs, triples)), owner

    def weights(self, batch: list[str], ratio: np.ndarray) -> np.ndarray:
        """The mean of ratio over each text's n-grams; 0 where there is none."""
        buckets, owner = self(batch)
        if not len(owner):
            return np.zeros(len(batch))
        total = np.bincount(owner, ratio[buckets[0]] + ratio[buckets[1]] + ratio[buckets[2]], len(batch))
        return total / np.maximum(1, 3 * np.bincount(owner, minlength=len(batch)))


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One vector of counts for each task: whatever the task's rows, it sends BUCKETS rows at most."""
    total, grams = np.zeros(BUCKETS, np.int64), NGrams()
    for whole in batches:
        for batch in slices(whole, 2 << 20):
            for family in grams(texts(batch.column(0)))[0]:
                total += np.bincount(family, minlength=BUCKETS)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(total[seen])], ["bucket", "n"])


def count_buckets(docs: DataFrame) -> np.ndarray:
    """Counts of all n-grams of all rows by bucket: BUCKETS numbers, summed on the executors."""
    counted = docs.select("text").mapInArrow(_bucket_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.float64)
    for bucket, n in counted.collect():  # BUCKETS rows at most
        out[bucket] = n
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """log p_target - log p_raw of every bucket, both smoothed towards the raw distribution's support."""
    share = (raw + smoothing) / (raw.sum() + smoothing * len(raw))
    prior = smoothing * len(raw)
    return np.log((target + prior * share) / (target.sum() + prior)) - np.log(share)


def calibrate(means: np.ndarray, good: np.ndarray, prior: float = PRIOR) -> tuple[float, float]:
    """(intercept, slope) of the log odds of good given the mean log ratio: a logistic regression with a weak prior on the
    slope. Without both kinds of labels the slope is 1."""
    y = good.astype(float)
    if not len(y) or y.min() == y.max():
        return 0.0, 1.0
    centre, scale = means.mean(), means.std() or 1.0
    x = np.stack([np.ones(len(y)), (means - centre) / scale], 1)
    fit = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ fit, -30, 30)))
        slope = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-9, prior])
        fit = fit + np.linalg.solve(slope, x.T @ (y - p) - np.array([0, prior * fit[1]]))
    return float(fit[0] - fit[1] * centre / scale), float(fit[1] / scale)


def _scored(ratio: np.ndarray, line: tuple[float, float], whole: bool):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = NGrams()
        for batch in (part for every in batches for part in slices(every, 2 << 20)):
            values = line[0] + line[1] * grams.weights(texts(batch.column(batch.schema.get_field_index("text"))), ratio)
            keep = [i for i, f in enumerate(batch.schema) if whole or f.name != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(values, pa.float64())], [*(batch.schema.names[i] for i in keep), WEIGHT])

    return score


def score_rows(rows: DataFrame, ratio: np.ndarray, line: tuple[float, float] = (0.0, 1.0), whole: bool = False) -> DataFrame:
    """rows with their log weight in place of text, or beside it if the whole rows are wanted."""
    schema = T.StructType([f for f in rows.schema if whole or f.name != "text"]).add(WEIGHT, T.DoubleType())
    return rows.mapInArrow(_scored(ratio, line, whole), schema)


def gumbel(column: str, seed: int = 8) -> F.Column:
    """Standard Gumbel noise that depends on the document's id alone."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(column)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


def _ordered_bits(column: str) -> F.Column:
    """The key as a whole number of 2^-20: what lies in one such step counts as a tie."""
    return F.floor(F.col(column) * F.lit(float(1 << 20))).cast("long")


def kth_largest(values: DataFrame, column: str, k: int, bins: int = 1 << 12) -> int | None:
    """The k-th largest value of a long column, exactly: histograms of `bins` counts narrow the range round by round.

    Only the counts reach the driver. None if k < 1 or the table is empty; the smallest value if k exceeds the rows.
    """
    low, high, n = values.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or k < 1:
        return None
    k = min(k, n)
    while low < high:
        width = max(1, -(-(high - low + 1) // bins))
        inside = values.filter(F.col(column).between(low, high))
        counts = dict(inside.groupBy(F.expr(f"({column} - {low}L) div {width}L").alias("b")).count().collect())
        for b in sorted(counts, reverse=True):
            if k <= counts[b]:
                low, high = low + b * width, min(high, low + (b + 1) * width - 1)
                break
            k -= counts[b]
    return low


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, text, quality) of at most `bound` labelled ids: the first in hashed order. The ids are broadcast: bound rows."""
    ids = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    ids = ids.orderBy(hashed_order("doc_id"), "doc_id").limit(bound)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def best_threshold(weights: np.ndarray, good: np.ndarray, loss_of_good: float = 20.0) -> float:
    """The log weight from which documents are taken as target-like: a good document lost costs loss_of_good bad ones kept."""
    if len(weights) == 0:
        return -math.inf
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    cost = np.concatenate([[0.0], np.cumsum(np.where(g, loss_of_good, 0.0) - np.where(g, 0.0, 1.0))])
    at = int(np.argmin(cost))
    if at == 0:
        return -math.inf
    return float(w[at - 1] + w[at]) / 2 if at < len(w) else float(w[-1]) + 1


class Resampler:
    """The scored rows and the drawn threshold."""

    def __init__(self, rows: DataFrame, cut: int | None, k: int) -> None:
        self.rows, self.cut, self.k = rows, cut, k

    def kept(self) -> F.Column:
        return F.lit(False) if self.cut is None else _ordered_bits(KEY) >= F.lit(self.cut)


def with_key(rows: DataFrame, seed: int = 8) -> DataFrame:
    return rows.withColumn(KEY, F.col(WEIGHT) + gumbel("doc_id", seed))


def draw(weighed: DataFrame, k: int, seed: int = 8) -> Resampler:
    """The k rows of the largest log weight plus Gumbel noise: a draw of k documents without replacement, each time in
    proportion to the weights of those left."""
    rows = with_key(weighed, seed)
    return Resampler(rows, kth_largest(rows.select(_ordered_bits(KEY).alias("v")), "v", k), k)


def weigh(docs: DataFrame, labels: DataFrame, whole: bool = False) -> tuple[DataFrame, float]:
    """Count and weigh: the documents' log weights, written once, and the weight from which the labelled sample says good."""
    sample = materialise(labelled_sample(docs, labels), "labelled")  # MAX_LABELLED ids at most
    raw = count_buckets(docs)
    target = count_buckets(sample.filter("quality = 1"))
    ratio = log_ratio(target, raw) if target.sum() else np.zeros(BUCKETS)
    seen = score_rows(sample.select("quality", "text"), ratio).collect()  # pairs of numbers
    means, good = np.array([r[WEIGHT] for r in seen]), np.array([r["quality"] == 1 for r in seen], bool)
    line = calibrate(means, good)
    threshold = best_threshold(line[0] + line[1] * means, good)
    return materialise(score_rows(docs if whole else docs.select("doc_id", "text"), ratio, line, whole), "weights"), threshold


def fit(docs: DataFrame, labels: DataFrame, whole: bool = False, keep: int | None = None, seed: int = 8) -> Resampler:
    """Count, weigh and draw `keep` documents; by default the number whose weight is target-like, by the labelled sample's
    threshold. A smaller number cuts into the good ones, and the noise decides which of them stay, by their weights.

    Null texts count as empty and have a mean log ratio of 0; repeated rows draw the same noise and stay or go together, so
    ties at the k-th key are all kept; labels of unknown documents do nothing; without labels all documents are kept; an
    empty table gives an empty one; texts of any length are read whole, in batches. The scored rows are written once.
    """
    rows, threshold = weigh(docs, labels, whole)
    return draw(rows, rows.filter(F.col(WEIGHT) >= threshold).count() if keep is None else keep, seed)


def resample(docs: DataFrame, labels: DataFrame, keep: int | None = None, seed: int = 8) -> DataFrame:
    """The rows of docs that the sample holds, columns as they came."""
    model = fit(docs, labels, True, keep, seed)
    return model.rows.filter(model.kept()).select(*docs.columns)


def op8_importance_resample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels)
    return model.rows.select("doc_id", F.col(WEIGHT).alias("log_weight"), F.col(KEY).alias("key"), model.kept().alias("kept"))
