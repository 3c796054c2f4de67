"""Language identification (operator 5): a bidirectional gated recurrent network over bytes, trained in numpy.

A text's bytes are cut into windows that run over words and lines; the network reads each window in both directions and
labels every position. A document's probabilities pool the log probabilities of all its positions. Training is by
backpropagation through time on windows of a bounded sample of documents, which has a quota for each language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm._common import slices, texts

#: Training documents in all, in equal parts for each language, but so many of each language at least; windows of each,
#: spread over its whole text. These bound what the driver holds.
MAX_TRAIN_DOCS, LEAST_DOCS, DOC_WINDOWS = 4000, 200, 12
#: Bytes of a window, units of each direction, most steps, windows of a step, learning rate, and the loss (nats a position,
#: a running mean) at which training ends.
WINDOW, HIDDEN, STEPS, BATCH, RATE, ENOUGH = 48, 12, 300, 256, 0.02, 0.05
#: Windows that are read together.
CHUNK = 4096
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether a character is a letter; superscripts and fractions, which count as word characters, aren't."""
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def windows(raw: bytes) -> list[bytes]:
    """All bytes in order, WINDOW in each but the last."""
    return [raw[i : i + WINDOW] for i in range(0, len(raw), WINDOW)]


def encoded(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def pack(sequences: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(time x sequence bytes, lengths), padded at the end."""
    lengths = np.array([len(s) for s in sequences], np.int64)
    width = int(lengths.max(initial=1))
    flat = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in sequences), np.uint8).reshape(len(sequences), width)
    return np.ascontiguousarray(flat.T), lengths


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.minimum(x, 30, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _tanh(x: np.ndarray) -> np.ndarray:
    """Through the exponential, which numpy has as vector code on every machine."""
    x *= 2
    x = _sigmoid(x)
    x *= 2
    x -= 1
    return x


class ByteGRU:
    """One layer in each direction; gates are ordered update, reset, candidate. Padded positions carry the state unchanged."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        self.p: dict[str, np.ndarray] = {}
        for way in "fb":
            self.p[f"x{way}"] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
            self.p[f"h{way}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32)
        self.p["out"] = rng.normal(0, 1 / np.sqrt(2 * hidden), (2 * hidden, len(labels))).astype(np.float32)
        self.p["bias"] = np.zeros(len(labels), np.float32)

    def _run(self, way: str, data: np.ndarray, live: np.ndarray, keep: list | None = None) -> np.ndarray:
        n, h = self.hidden, np.zeros((data.shape[1], self.hidden), np.float32)
        wx, wh = self.p[f"x{way}"], self.p[f"h{way}"]
        gate, own = np.ascontiguousarray(wh[:, : 2 * n]), np.ascontiguousarray(wh[:, 2 * n :])
        states = np.zeros((*data.shape, n), np.float32)
        for t in range(len(data)) if way == "f" else range(len(data) - 1, -1, -1):
            x = wx[data[t]]
            gates = h @ gate
            gates += x[:, : 2 * n]
            gates = _sigmoid(gates)
            z, r = gates[:, :n], gates[:, n:]
            c = (r * h) @ own
            c += x[:, 2 * n :]
            c = _tanh(c)
            new = h + z * (c - h)
            if not live[t].all():
                new = np.where(live[t][:, None], new, h)
            if keep is not None:
                keep.append((t, h, z, r, c))
            h = states[t] = new
        return states

    def log_probabilities(self, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """time x sequence x label."""
        live = np.arange(len(data))[:, None] < lengths[None, :]
        n = self.hidden
        logits = self._run("f", data, live) @ self.p["out"][:n] + self._run("b", data, live) @ self.p["out"][n:] + self.p["bias"]
        logits -= logits.max(2, keepdims=True)
        return logits - np.log(np.exp(logits).sum(2, keepdims=True))

    def document_scores(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Each text's summed log probabilities over all its bytes, and their number. CHUNK windows are read together, full
        ones apart from the texts' last ones, so memory doesn't depend on the texts."""
        total, positions = np.zeros((len(raw), len(self.labels))), np.array([len(r) for r in raw], float)

        def read(sequences: list[bytes], owner: list[int]) -> None:
            data, lengths = pack(sequences)
            found = self.log_probabilities(data, lengths)
            if lengths.min() < len(data):
                found[np.arange(len(data))[:, None] >= lengths[None, :]] = 0
            np.add.at(total, np.array(owner), found.sum(0))

        full: tuple[list[bytes], list[int]] = ([], [])
        tails = sorted((i for i, r in enumerate(raw) if len(r) % WINDOW), key=lambda i: len(raw[i]) % WINDOW)
        for i, r in enumerate(raw):
            for at in range(0, len(r) - WINDOW + 1, WINDOW):
                full[0].append(r[at : at + WINDOW])
                full[1].append(i)
                if len(full[0]) == CHUNK:
                    read(*full)
                    full = ([], [])
        if full[0]:
            read(*full)
        for at in range(0, len(tails), CHUNK):
            own = tails[at : at + CHUNK]
            read([raw[i][len(raw[i]) - len(raw[i]) % WINDOW :] for i in own], own)
        return total, positions

    def gradients(self, data: np.ndarray, lengths: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all live positions and its gradients, by backpropagation through time."""
        n = self.hidden
        live = np.arange(len(data))[:, None] < lengths[None, :]
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self._run(way, data, live, kept[way]) for way in "fb"], 2)
        logits = both @ self.p["out"] + self.p["bias"]
        logits -= logits.max(2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(2, keepdims=True)
        count = live.sum()
        picked = prob[:, np.arange(len(label)), label]
        loss = float(-(np.log(picked + 1e-9) * live).sum() / count)
        prob[:, np.arange(len(label)), label] -= 1
        d_logits = prob * (live[:, :, None] / count)
        grads = {"out": np.einsum("tbh,tbk->hk", both, d_logits, optimize=True), "bias": d_logits.sum((0, 1))}
        d_both = d_logits @ self.p["out"].T
        for way, part in (("f", d_both[:, :, :n]), ("b", d_both[:, :, n:])):
            wh = self.p[f"h{way}"]
            dx, dwh = np.zeros_like(self.p[f"x{way}"]), np.zeros_like(wh)
            carry = np.zeros((data.shape[1], n), np.float32)
            for t, h, z, r, c in reversed(kept[way]):
                carry = carry + part[t]
                on = live[t][:, None]
                here = np.where(on, carry, 0)
                d_c = here * z * (1 - c * c)
                d_z = here * (c - h) * z * (1 - z)
                d_rh = d_c @ wh[:, 2 * n :].T
                d_r = d_rh * h * r * (1 - r)
                d_gates = np.concatenate([d_z, d_r], 1)
                dwh[:, : 2 * n] += h.T @ d_gates
                dwh[:, 2 * n :] += (r * h).T @ d_c
                full = np.concatenate([d_gates, d_c], 1)
                hot = np.zeros((256, len(label)), np.float32)
                hot[data[t], np.arange(len(label))] = 1
                dx += hot @ full
                back = here * (1 - z) + d_rh * r + d_gates @ wh[:, : 2 * n].T
                carry = np.where(on, back, carry)
            grads[f"x{way}"], grads[f"h{way}"] = dx, dwh
        return loss, grads


def train(sample: list[tuple[str, bytes]], seed: int = 5, steps: int = STEPS, hidden: int = HIDDEN, enough: float = ENOUGH) -> ByteGRU | None:
    """Fit on (label, window), languages equally often, until the running loss is `enough` or the steps end. None without a
    window."""
    by_label: dict[str, list[bytes]] = {}
    for lab, window in sorted(sample):
        if window:
            by_label.setdefault(lab, []).append(window)
    if not by_label:
        return None
    labels = sorted(by_label)
    model, rng = ByteGRU(labels, hidden, seed), np.random.default_rng(seed)
    if len(labels) == 1:
        return model
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    running = np.log(len(labels))
    for step in range(1, steps + 1):
        target = rng.integers(0, len(labels), BATCH)
        drawn = [by_label[labels[k]][int(u * len(by_label[labels[k]]))] for k, u in zip(target.tolist(), rng.random(BATCH).tolist(), strict=True)]
        loss, grads = model.gradients(*pack(drawn), target)
        running = 0.9 * running + 0.1 * loss
        size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        rate = RATE * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            g = g * min(1.0, 1.0 / (size + 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            model.p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        if running < enough:
            break
    return model


def predict(model: ByteGRU | None, batch: list[str]) -> tuple[list[str], list[float]]:
    """Labels and scores of texts."""
    names, scores = ["und"] * len(batch), [0.0] * len(batch)
    known = [i for i, t in enumerate(batch) if model is not None and has_letter(t)]
    if known:
        total, positions = model.document_scores([encoded(batch[i]) for i in known])
        mean = total / positions[:, None]
        share = np.exp(mean - mean.max(1, keepdims=True))
        best = mean.argmax(1)
        for i, k, s in zip(known, best.tolist(), (share.max(1) / share.sum(1)).tolist(), strict=True):
            names[i], scores[i] = model.labels[k], float(min(1.0, s))
    return names, scores


def _predict_rows(model: ByteGRU | None):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2 << 20):
                names, scores = predict(model, texts(batch.column(2)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return rows


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _cut(most: int):
    """(lang, window): at most `most` windows of each text, evenly spread over the whole of it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, found = [], []
            for lang, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                raw = encoded(text)
                last = max(0, len(raw) - WINDOW)
                places = sorted({round(last * i / max(1, most - 1)) for i in range(most)}) if last >= most else range(0, last + 1, WINDOW)
                for at in places:
                    langs.append(lang)
                    found.append(raw[at : at + WINDOW])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.binary())], ["lang", "window"])

    return cut


def training_sample(docs: DataFrame, most: int = MAX_TRAIN_DOCS, least: int = LEAST_DOCS) -> list[tuple[str, bytes]]:
    """(lang, window) of a bounded sample of the texts of documents that have a language and aren't held out: each language
    has the same quota, the first of its different texts in hashed order, so none is left out however small it is, and
    neither copies nor repeated doc_ids add to it."""
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}") & F.col("doc_id").isNotNull() & ~held_out())
    usable = usable.select(F.col("lang").cast("string").alias("lang"), F.shiftrightunsigned(F.xxhash64("text"), 4).alias("u"), "text")
    keys = usable.select("lang", "u").distinct()
    sizes = keys.groupBy("lang").agg(F.count("*").alias("size")).collect()  # one row for each label of the model
    if not sizes:
        return []
    quota = max(least, most // len(sizes))
    # a frequent language's texts are thinned by the hash before they are ranked: three quotas of them are expected to be left
    early = F.broadcast(docs.sparkSession.createDataFrame([(r["lang"], float(1 << 60) * 3 * (quota + 10) / r["size"]) for r in sizes], "lang string, below double"))
    first = usable.select("lang", "u").join(early, "lang").filter(F.col("u") < F.col("below")).select("lang", "u").distinct()
    ids = first.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("u"))).filter(F.col("n") <= quota).drop("n")
    picked = usable.join(F.broadcast(ids), ["lang", "u"]).groupBy("lang", "u").agg(F.first("text").alias("text"))  # quota texts a language
    return [(r["lang"], bytes(r["window"])) for r in picked.select("lang", "text").mapInArrow(_cut(DOC_WINDOWS), "lang string, window binary").collect()]


def identify(docs: DataFrame, steps: int = STEPS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row.

    `und` with score 0 for null texts, texts without a letter, and where there was nothing to learn from. Null doc_ids
    are predicted, not learned from and not held out; repeated rows give repeated results; further columns are ignored; an
    empty table gives an empty one. Texts are read whole, in chunks of windows, so a very long one needs no more memory.
    """
    model = train(training_sample(docs), steps=steps)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(_predict_rows(model), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op5_byte_gru(docs: DataFrame) -> DataFrame:
    return identify(docs)
