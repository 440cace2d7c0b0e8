"""Language identification by averaged hashed subword embeddings and a linear softmax.

Subwords are the byte n-grams (1 to 4 bytes of UTF-8, A-Z lower-cased) of words with one space at each end. A subword's hash selects a
row of the embedding table; a text is the mean of its rows, and a linear layer with softmax scores the languages. Embeddings and layer
are trained together by mini-batch gradient steps in numpy. The scores are calibrated by a temperature, and a threshold of rejection is
set, both on a part of the learning rows that the training hasn't seen.

Training reads a bounded sample of labelled rows: at most `per_language` whole texts of each language, and `most_rows` of all, those of
the least seeded hash, one of each language before a second of any, as counts of subwords (BUCKETS numbers each). What reaches the driver is bounded by MOST_ROWS * BUCKETS numbers.
The model is buckets * languages numbers when it predicts: the layer is applied to the embedding table beforehand.

Defined cases: a null text or one without a letter is `und` with score 0; with no labelled rows everything is `und`; ties go to the
language that sorts first; languages are any values of the label column; copies of a text are learned once in each language, so a
language whose rows are all copies is learned from its few texts; columns of other names are kept, and those that are named as what
identify adds are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redactory.llm.arrow import map_arrow
from redactory.session import forget, materialize

BUCKETS, LONGEST = 4096, 4
#: Labelled rows that training reads at most, of each language and of all together.
PER_LANGUAGE, MOST_ROWS = 600, 6000
#: Bits of the ranges in which a language's texts are counted.
RANGE_BITS = 14
#: What identify() adds to the columns of a table.
COLUMNS = ("lang_pred", "score", "rejected")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if b in (9, 10, 11, 12, 13) else b for b in range(256))
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def subwords(data: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: the bucket of the n-gram at each place, and whether there is one (no space inside, not a lone space)."""
    space = data == 32
    n = len(data)
    h = np.full(n, 2166136261, np.uint32)
    inner = np.zeros(n, bool)
    for size in range(1, LONGEST + 1):
        m = n - size + 1
        if m <= 0:
            return
        h = (h[:m] ^ data[size - 1 :]) * np.uint32(16777619)
        # spaces may stand at the ends only
        inner = inner[:m] | (space[size - 2 : size - 2 + m] if size > 2 else False)
        good = ~inner & ~(space[:m] & space[size - 1 :])
        yield ((h ^ (h >> np.uint32(15))) & np.uint32(buckets - 1)).astype(np.intp), good


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts with two spaces around each (so no n-gram spans two), and where each text starts."""
    parts = [b"  " + t.translate(_LOWER) + b" " for t in texts]
    return np.frombuffer(b"".join(parts) + b"  ", np.uint8), np.cumsum([0, *map(len, parts)])


def subword_counts(text: bytes, buckets: int = BUCKETS) -> np.ndarray:
    out = np.zeros(buckets)
    data, _ = joined([text])
    for at, good in subwords(data, buckets):
        out += np.bincount(at[good], minlength=buckets)
    return out


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (buckets, languages): embeddings times the layer
    bias: np.ndarray
    temperature: float
    threshold: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Calibrated probabilities, (texts, languages). Texts are scored in slices of bounded size; a long text is summed over slices."""
        sums, counts = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) < 1 << 19):
                size += len(texts[end])
                end += 1
            data, starts = joined(texts[at:end])
            for low in range(0, len(data), 1 << 20):
                part = data[low : low + (1 << 20) + LONGEST - 1]
                for k, (where, good) in enumerate(subwords(part, len(self.table)), 1):
                    last = min(len(where), 1 << 20)
                    hit = np.flatnonzero(good[:last])
                    owner = np.searchsorted(starts, hit + low, side="right") - 1
                    owner = np.minimum(owner, end - at - 1)
                    counts[at:end] += np.bincount(owner, minlength=end - at)
                    rows = self.table[where[:last][hit]]
                    for c in range(len(self.languages)):
                        sums[at:end, c] += np.bincount(owner, rows[:, c], minlength=end - at)
            at = end
        logits = (sums / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature
        p = np.exp(logits - logits.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def fit(counts: np.ndarray, labels: np.ndarray, languages: list[str], *, width: int = 16, rounds: int = 30, rate: float = 2.0, seed: int = 5) -> Model:
    """Trains on rows of subword counts; every fifth row is kept for calibration."""
    rng = np.random.default_rng(seed)
    k = len(languages)
    mean = (counts / np.maximum(counts.sum(1, keepdims=True), 1)).astype(np.float32)
    apart = np.arange(len(mean)) % 5 == 4
    if not apart.any() or apart.all():
        apart[:] = False
    x, y = mean[~apart], labels[~apart]
    embed, layer, bias = rng.normal(0, 0.1, (counts.shape[1], width)).astype(np.float32), rng.normal(0, 0.1, (width, k)).astype(np.float32), np.zeros(k, np.float32)
    seen = [np.full(p.shape, 1e-8, np.float32) for p in (embed, layer, bias)]
    for _ in range(rounds):
        order = rng.permutation(len(x))
        for i in range(0, len(x), 64):
            own = order[i : i + 64]
            hidden = x[own] @ embed
            z = hidden @ layer + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(own)), y[own]] -= 1
            p /= len(own)
            grads = (x[own].T @ (p @ layer.T), hidden.T @ p, p.sum(0))
            for w, g, s in zip((embed, layer, bias), grads, seen, strict=True):
                s += g * g
                w -= 0.1 * rate * g / np.sqrt(s)
    table = (embed @ layer).astype(np.float64)
    held, truth = (mean[apart], labels[apart]) if apart.any() else (x, y)
    logits = held @ table + bias
    best = (np.inf, 1.0)
    for t in np.geomspace(0.05, 20, 60):
        q = logits / t
        loss = np.mean(np.log(np.exp(q - q.max(1, keepdims=True)).sum(1)) + q.max(1) - q[np.arange(len(q)), truth])
        best = min(best, (loss, t))
    q = logits / best[1]
    top = (p := np.exp(q - q.max(1, keepdims=True))).max(1) / p.sum(1)
    right = p.argmax(1) == truth
    # rejected below this: the least score above which 99 % of the held rows are right
    order = np.argsort(-top)
    share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(share >= 0.99)
    return Model(languages, table, bias.astype(np.float64), float(best[1]), float(top[order[good[-1]]]) if len(good) else 1.0)


def learn(labelled: DataFrame, *, text_col: str = "text", label_col: str = "lang", per_language: int = PER_LANGUAGE, most_rows: int = MOST_ROWS, seed: int = 5) -> Model | None:
    """Fits a model to a bounded sample of rows with a text and a label; None if there are none.

    The sample is of distinct texts, those of the least hashes. Texts are counted by ranges of the hash first, and only those of the first
    ranges are ranked, so a task gets little more than a language's bound, however many texts it has. Languages are those of the sample.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    near = rows.withColumn("h", F.xxhash64("text", F.lit(seed)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [subword_counts((t or "").encode()) for t in b.column(2).to_pylist()]
            packed = [c.astype("<u4").tobytes() for c in counts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary())], names=["lang", "h", "counts"])

    # ranges of the hash, in unsigned order: those up to the one in which a language's bound is reached hold its sample
    texts = materialize(near.select("lang", "h").distinct().withColumn("range", F.shiftrightunsigned("h", 64 - RANGE_BITS)), "labelled-texts")
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy("range"))
    sizes = texts.groupBy("lang", "range").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", upto)
    ends = materialize(sizes.where(F.col("upto") - F.col("n") < per_language).groupBy("lang").agg(F.max("range").alias("last")), "labelled-ends")
    first = Window.partitionBy("lang").orderBy(F.col("h").bitwiseXOR(F.lit(-(1 << 63))))  # the sign bit is turned
    few = texts.join(ends, "lang").where(F.col("range") <= F.col("last")).select("lang", "h")
    picked = few.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= per_language).orderBy("rank", "lang").limit(most_rows).select("lang", "h")
    sample = map_arrow(near.join(F.broadcast(picked), ["lang", "h"], "left_semi").select("lang", "h", "text").dropDuplicates(["lang", "h"]), run, "lang string, h long, counts binary").orderBy("lang", "h").collect()
    forget(texts, ends)
    if not sample:
        return None
    languages = sorted({r.lang for r in sample})
    index = {x: i for i, x in enumerate(languages)}
    labels = np.array([index[r.lang] for r in sample])
    counts = np.array([np.frombuffer(r.counts, "<u4") for r in sample], np.float32)
    mixed = np.random.default_rng(seed).permutation(len(sample))
    return fit(counts[mixed], labels[mixed], languages, seed=seed)


def identify(docs: DataFrame, model: Model | None, *, text_col: str = "text") -> DataFrame:
    """Columns of docs but the text, with lang_pred, score (calibrated, 0 to 1) and rejected (score below the model's threshold)."""
    keep = [c for c in docs.columns if c != text_col and c not in COLUMNS]
    own = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [(t or "").encode() for t in b.column(len(keep)).to_pylist()]
            live = [i for i, t in enumerate(texts) if model is not None and has_letter(t)]
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            if live:
                p = model.scores([texts[i] for i in live])
                for i, c, s in zip(live, p.argmax(1), p.max(1), strict=True):
                    names[i], scores[i] = model.languages[c], float(s)
            rejected = [n == "und" or s < model.threshold for n, s in zip(names, scores, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(names), pa.array(scores, pa.float64()), pa.array(rejected)], names=[*keep, *COLUMNS])

    kinds = ", ".join(f"`{n}` {t}" for n, t in own.dtypes[:-1])
    return map_arrow(own, run, f"{kinds}, lang_pred string, score double, rejected boolean")
