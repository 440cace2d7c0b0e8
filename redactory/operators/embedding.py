"""Embeddings, category centroids, routing, the business flag and semantic keywords.

The built-in embedder hashes words and their trigrams into 256 buckets, batch by batch in numpy. Others come in as an Embedder (see
redactory.sources.embedder) and give a vector column of their own.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping
from functools import lru_cache, partial
from importlib import resources
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redactory.functions import lexicon as fixed
from redactory.functions.arrays import batched, flat_of, lists, strings
from redactory.functions.predicates import is_secret_shaped, trim_word, unquoted
from redactory.functions.tokens import plain_tokens
from redactory.operators.infra import Ranges
from redactory.operators.spans import Found, no_spans, span

DIM = 256
#: Constants of the hash (FNV-1a, 32 bits): fixed values.
FNV_START, FNV_PRIME, MASK = 2166136261, 16777619, 0xFFFFFFFF


def load_data(name: str) -> dict | None:
    """A data file of the package, or None if it can't be read: what needs it is then off."""
    try:
        return json.loads(resources.files("redactory").joinpath("data", name).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return None


# --- hashing embedder


def _buckets(word: str, dim: int) -> tuple[int, ...]:
    """Buckets of a word and, if it has four letters or more, of its trigrams, which a hash sign marks.

    A bucket is the FNV-1a hash as a signed 32-bit number, without its sign, modulo the dimension.
    """
    out = []
    for g in (word, *("#" + word[i : i + 3] for i in range(len(word) - 2) if len(word) >= 4)):
        h = FNV_START
        for c in g.encode("ascii"):
            h = (h ^ c) * FNV_PRIME & MASK
        out.append(min(h, MASK + 1 - h) % dim)
    return tuple(out)


_remembered = lru_cache(maxsize=200_000)(_buckets)
_WORDS = re.compile("[a-z0-9]+")


def vector_of(text: str, dim: int = DIM) -> np.ndarray:
    """A vector of length 1; zeros for a text without words."""
    own = chain.from_iterable(_remembered(w, dim) if len(w) <= 60 else _buckets(w, dim) for w in _WORDS.findall(text.lower()))
    counts = np.bincount(np.fromiter(own, np.int64), minlength=dim).astype(float)
    return counts / (np.sqrt((counts**2).sum()) or 1.0)


def embed_text(text: str, dim: int = DIM) -> list[float]:
    return vector_of(text, dim).tolist()


def _embed(dim: int, texts: pa.Array) -> pa.Array:
    rows = [vector_of(t, dim) for t in strings(texts)]
    values = np.concatenate(rows) if rows else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * dim, pa.int32()), pa.array(values))


def embed(text: Column, dim: int = DIM) -> Column:
    """array<double> of length 1 (zeros for a text without words)."""
    return batched(partial(_embed, dim), "array<double>", text)


def cosine(a: Column, b: Column) -> Column:
    """Dot product of vectors of length 1."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


# --- centroids and routing


def centroids(examples: DataFrame, vector: Column | None = None) -> DataFrame:
    """category, vector: the mean of the examples' vectors (category, example) at length 1. Vectors of unequal or no length are an error."""
    rows = examples.select("category", (embed(F.col("example")) if vector is None else vector).alias("v"))
    sized = rows.groupBy("category").agg(F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high"))
    means = rows.select("category", F.posexplode("v").alias("i", "x")).groupBy("category", "i").agg(F.avg("x").alias("x"))
    whole = means.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("p"))  # a row for each dimension
    norm = F.sqrt(F.aggregate("p", F.lit(0.0), lambda acc, p: acc + p["x"] * p["x"]))
    out = whole.select("category", F.transform("p", lambda p: p["x"] / F.when(norm > 0, norm).otherwise(1.0)).alias("vector"))
    checked = F.when((F.col("low") > 0) & (F.col("low") == F.col("high")), F.col("vector")).otherwise(F.raise_error(F.lit("examples have vectors of different lengths")).cast("array<double>"))
    return out.join(sized, "category").select("category", checked.alias("vector"))


@lru_cache(maxsize=8)
def built_in_centroids(dim: int = DIM) -> tuple[tuple[str, tuple[float, ...]], ...]:
    """(category, vector) from the package's example sentences; empty if these are missing."""
    out = []
    for category, examples in (load_data("category_examples.json") or {}).items():
        mean = np.mean([vector_of(e, dim) for e in examples], axis=0)
        out.append((category, tuple((mean / (np.sqrt((mean**2).sum()) or 1.0)).tolist())))
    return tuple(out)


Centroids = tuple[tuple[str, tuple[float, ...]], ...]


def ranked(vectors: np.ndarray, known: Centroids) -> list[list[tuple[str, float]]]:
    """(category, score) of each vector, best first; of equal scores the category that comes first."""
    dots = vectors @ np.array([w for _, w in known]).T
    return [[(known[i][0], float(row[i])) for i in sorted(range(len(known)), key=lambda i: -row[i])] for row in dots]


def _scores(known: Centroids, vectors: pa.Array) -> pa.Array:
    flat, at = flat_of(vectors)
    dim, values, out = len(known[0][1]), flat.to_numpy(zero_copy_only=False), [[] for _ in range(len(vectors))]
    fits = np.flatnonzero(np.diff(at) == dim)
    if len(fits):
        rows = values[at[fits][:, None] + np.arange(dim)].astype(float)
        for i, found in zip(fits, ranked(rows, known), strict=True):
            out[i] = found
    return lists(out, ("category", "score"), (pa.string(), pa.float64()))


def scores(vector: Column, known: Centroids | None = None) -> Column:
    """array<struct<category, score>>, best first. Empty if there are no centroids or the vector is of another length."""
    known = built_in_centroids() if known is None else known
    if not known:
        return F.array().cast("array<struct<category:string,score:double>>")
    return batched(partial(_scores, known), "array<struct<category:string,score:double>>", vector)


def route(vector: Column, least: float = fixed.ROUTE_MIN, most: int = 10) -> Column:
    """Categories with at least a score, at most so many."""
    return F.slice(F.filter(scores(vector), lambda s: s["score"] >= least), 1, most)


def score_of(ranked: Column, category: str) -> Column:
    return F.try_element_at(F.filter(ranked, lambda s: s["category"] == category), F.lit(1))["score"]


def gates(ranked: Column, least: float = fixed.ROUTE_MIN, always: bool = False) -> dict[str, Column]:
    """Which context detectors run: those whose category scores enough; all, if scores are missing."""
    open_ = F.lit(True) if always else (F.size(ranked) == 0)
    return {k: open_ | F.coalesce(score_of(ranked, c) >= least, F.lit(False)) for k, c in (("pii", "pii"), ("infra", "infrastructure"), ("secrets", "credentials"))}


def business_spans(text: Column, ranked: Column, least: float = fixed.BUSINESS_MIN) -> Column:
    """The whole text as one span, if business strategy ranks first with at least a score. Only for embedders that can tell whole messages apart."""
    score = ranked[0]["score"]
    low, high = fixed.BUSINESS_BANDS
    severity = F.when(score >= high, "high").when(score >= low, "medium").otherwise("low")
    preview = F.when(F.length(text) > 80, F.concat(F.substring(text, 1, 80), F.lit("…"))).otherwise(text)
    label = F.concat(F.lit("Possible confidential business content (embedding similarity "), F.format_string("%.2f", score), F.lit(")"))
    one = span(F.lit("business-strategy-contextual"), label, severity, F.lit("BUSINESS"), preview, F.lit(0), F.length(text))
    return F.when((F.size(ranked) > 0) & (ranked[0]["category"] == "business-strategy") & (score >= least), F.array(one)).otherwise(no_spans())


# --- semantic keywords

_STOPWORDS = frozenset(fixed.SEMANTIC_STOPWORDS)


def semantic_words(text: str) -> list[str]:
    """Words of a text that could stand for a keyword, each once, in order of appearance."""
    return list(dict.fromkeys(w.lower() for t, _, _ in plain_tokens(text) if _is_candidate(w := trim_word(t))))


def _is_candidate(word: str) -> bool:
    return 3 <= len(word) <= 24 and re.match(r"[A-Za-z][A-Za-z_-]*\Z", word) is not None and word.lower() not in _STOPWORDS


def banded(score: float, ceiling: str) -> str:
    low, high = fixed.SEMANTIC_BANDS
    return fixed.SEVERITIES[min((score >= low) + (score >= high), fixed.SEVERITIES.index(ceiling))]


#: Known vectors that a pass compares with.
BLOCK = 1000


def nearest(rows: DataFrame, vector: str, known: DataFrame, names: list[str], block: int = BLOCK, digits: int = 15) -> DataFrame:
    """rows with __at (struct of names and score): the known vector (names, vector) of the largest dot product with each row's; null if none fits.

    Known vectors are compared block by block in their order, one pass of rows for each; of equal scores (rounded to `digits`) the first
    counts. What is sent to the tasks at once is bounded by a block, however many there are.
    """
    spark = rows.sparkSession
    kinds = dict(known.dtypes)
    kind = f"struct<{', '.join(f'`{n}`:{kinds[n]}' for n in names)},score:double>"
    out = rows.withColumn("__at", F.lit(None).cast(kind))
    schema, columns = out.schema, rows.columns
    at, held = columns.index(vector), []

    def against(block_: list[tuple]) -> Callable:
        shared = spark.sparkContext.broadcast(([x[:-1] for x in block_], [x[-1] for x in block_]))

        def run(batches):
            labels, vectors = shared.value
            by_size = {d: (own := [i for i, v in enumerate(vectors) if len(v) == d], np.array([vectors[i] for i in own])) for d in {len(v) for v in vectors}}
            for b in batches:
                best = b.column(len(columns)).to_pylist()
                flat, starts = flat_of(b.column(at))
                values, size = flat.to_numpy(zero_copy_only=False).astype(float), np.diff(starts)
                for d, (own, matrix) in by_size.items():
                    fits = np.flatnonzero(size == d)
                    if d and len(fits):
                        scores_ = np.round(values[starts[fits][:, None] + np.arange(d)] @ matrix.T, digits)
                        first = scores_.argmax(1)
                        for i, j, s in zip(fits.tolist(), first.tolist(), scores_[np.arange(len(fits)), first].tolist(), strict=True):
                            if best[i] is None or s > best[i]["score"]:
                                best[i] = dict(zip(names, labels[own[j]], strict=True)) | {"score": s}
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(best, b.schema.field("__at").type)], schema=b.schema)

        return run

    for r in known.select(*names, "vector").toLocalIterator():
        held.append((*r,))
        if len(held) == block:
            out, held = out.mapInArrow(against(held), schema), []
    return out.mapInArrow(against(held), schema) if held else out


def best_seeds(words: DataFrame, seeds: DataFrame, least: float = fixed.SEMANTIC_MIN) -> DataFrame:
    """word, group, label, category, severity, score: the nearest seed of each word (word, vector), if near enough.

    seeds: group, label, category, severity, seed, vector. Of equally near seeds the last in order of seed counts.
    """
    names = ["group", "label", "category", "severity"]
    found = nearest(words.select("word", "vector"), "vector", seeds.orderBy(F.desc("seed")), names)
    return found.where(F.col("__at.score") >= least).select("word", "__at.*")


def semantic_spans(text: str, taken: list[tuple[int, int]], nearest: Mapping[str, Nearest] | Callable[[str], Nearest | None], least: float = fixed.SEMANTIC_MIN) -> list[Found]:
    """Spans of the first secret-shaped token around each word that is near a seed. nearest: group, label, category, severity, score."""
    tokens, used, out = plain_tokens(text), Ranges(taken), []
    look = nearest if callable(nearest) else nearest.get
    free = [not used.touch(a, b) for _, a, b in tokens]
    for i, (raw, _, _) in enumerate(tokens):
        word = trim_word(raw)
        if not free[i] or not _is_candidate(word) or (hit := look(word.lower())) is None or hit[4] < least:
            continue
        group, label, category, severity, score = hit
        for j in range(max(0, i - fixed.SEMANTIC_WINDOW), min(len(tokens), i + fixed.SEMANTIC_WINDOW + 1)):
            value, start = unquoted(tokens[j][0], tokens[j][1])
            if j != i and free[j] and is_secret_shaped(value):
                out.append((f"semantic-{group}", f"{label} (similarity {score:.2f})", banded(score, severity), category, value, start, start + len(value)))
                break
    return sorted(out, key=lambda x: x[5])


Nearest = tuple[str, str, str, str, float]


@lru_cache(maxsize=2)
def _seed_vectors(dim: int = DIM) -> tuple[list[tuple[str, str, str, str]], np.ndarray]:
    rows = [(g, x["label"], x["category"], x["severity"], s) for g, x in (load_data("semantic_seeds.json") or {}).items() for s in x["seeds"]]
    return [r[:4] for r in rows], np.array([vector_of(r[4], dim) for r in rows]).reshape(-1, dim)


@lru_cache(maxsize=100_000)
def nearest_seed(word: str) -> Nearest | None:
    """The nearest seed of a word by the built-in embedder, with its score."""
    names, vectors = _seed_vectors()
    if not names:
        return None
    each = vectors @ vector_of(word)
    best = int(each.argmax())
    return (*names[best], float(each[best]))


def nearest_words(df: DataFrame, key: list[str], vectors: DataFrame, seeds: DataFrame, text_col: str = "text", least: float = fixed.SEMANTIC_MIN) -> DataFrame:
    """df with nearest (array<struct<word, group, label, category, severity, score>>): the words of each text that are near a seed.

    vectors: word, vector of all words by an embedder of one's own (see semantic_words). Only distinct words meet the seeds.
    """
    words = df.select(*key, F.explode(batched(_semantic_words, "array<string>", F.col(text_col))).alias("word"))
    known = best_seeds(vectors.join(words.select("word").distinct(), "word", "left_semi"), seeds, least)
    own = words.join(known, "word").groupBy(*key).agg(F.collect_list(F.struct("word", "group", "label", "category", "severity", "score")).alias("nearest"))  # near words of one text
    return df.join(own, key, "left")


def _semantic_words(texts: pa.Array) -> pa.Array:
    return pa.array([semantic_words(t) for t in strings(texts)], pa.list_(pa.string()))


def seed_table(spark: SparkSession) -> DataFrame:
    rows = [(g, x["label"], x["category"], x["severity"], s) for g, x in (load_data("semantic_seeds.json") or {}).items() for s in x["seeds"]]
    return spark.createDataFrame(rows, "group string, label string, category string, severity string, seed string")
