"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted hash arrays, memory-mapped by the workers that score.

Tokens are words `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z, then one end; the context of a text's first token is a start mark. Words
are 64-bit hashes (XXH64); a bigram is a 64-bit key of its two words.

Counting: each task sums the bigrams of some millions of tokens and deals them out, packed in arrays, by context. There is a shard for
every SHARD_BYTES of text, and a context's bigrams are spread over an eighth of the shards (SPREAD at least), so neither a shard nor what a
frequent context brings to one grows with the corpus. A shard adds up its bigrams and writes their keys in order with their
counts; what it knows of words (as contexts: total and types by count; as followers: types and count) goes on, packed, to the word
shards, which add up and write the word tables. Both are files in the shared folder, named by attempt; the manifest that Spark commits
names those that count. Discounts and totals come from sums over the manifest, one row per shard. Nothing but these sums is collected.

With c the count of a bigram, t and n1, n2, n3 the total and the types of its context (once, twice, more often), T the number of bigram
types, k the types that end in w, V the number of distinct tokens, D and E the discounts from counts of counts of c and k:

    p(w | u) = max(c - D(c), 0) / t + (D1 n1 + D2 n2 + D3 n3) / t * q(w)     q(w) where u was never a context
    q(w) = max(k - E(k), 0) / T + (E1 m1 + E2 m2 + E3 m3) / T / (V + 1)

Defined cases: null and empty texts are the end token alone; with no training rows every text's probability is that of the uniform
distribution over one unknown token; words never seen share q's last term; repeated rows count each; columns of other names are
kept by score, and those named as what it adds (COLUMNS) are replaced.

A worker maps the shards that its texts need, when they need them. Where the shared folder isn't a mounted path it copies those shards
first; a copy is unlinked as soon as it is mapped, so nothing stays behind when a worker ends.
"""

from __future__ import annotations

import shutil
import struct
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactory.llm.arrow import map_arrow, prepare
from redactory.llm.token_files import open_folder
from redactory.session import forget, materialize, remove, scratch_path

#: Marks hold a space, so no word has their bytes.
START, END = (xxhash.xxh64_intdigest(x) for x in (b" start", b" end"))
SPREAD, SHARD_BYTES = 8, 16 << 20
#: What score() adds to the columns of a table.
COLUMNS = ("n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity", "n_unseen", "n_once")
#: Tokens whose bigrams a task sums at once, and tokens that are scored at once.
SUM_TOKENS, SCORE_TOKENS = 4_000_000, 500_000


# --- arrays as bytes


def narrow(a: np.ndarray) -> np.ndarray:
    """Counts in the fewest bytes."""
    top = int(a.max()) if len(a) else 0
    return a.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")


def dump(*arrays: np.ndarray) -> bytes:
    """Number of arrays, (item size, length) of each, then their bytes from a multiple of 8 on."""
    head = struct.pack("<q", len(arrays)) + b"".join(struct.pack("<qq", a.dtype.itemsize, len(a)) for a in arrays)
    out = [head]
    for a in arrays:
        data = a.astype(f"<u{a.dtype.itemsize}", copy=False).tobytes()
        out += [data, b"\0" * (-len(data) % 8)]
    return b"".join(out)


def load(data) -> list[np.ndarray]:
    """Views of the arrays in bytes or in a memory map."""
    (n,) = struct.unpack_from("<q", data, 0)
    at, out = 8 + 16 * n, []
    for i in range(n):
        size, length = struct.unpack_from("<qq", data, 8 + 16 * i)
        out.append(np.frombuffer(data, f"<u{size}", length, at))
        at += size * length + -(size * length) % 8
    return out


# --- words and keys


class Vocabulary(dict):
    """Numbers of words in order of appearance; 0 and 1 are the start and the end."""

    def __init__(self):
        self[b" start"], self[b" end"] = 0, 1

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n

    def hashes(self) -> np.ndarray:
        h = xxhash.xxh64_intdigest
        return np.array([h(w) for w in self], "<u8")


def numbers_of(text: str | None, vocabulary: Vocabulary) -> list[int]:
    """A text's tokens between the start and the end."""
    return [0, *map(vocabulary.__getitem__, (text or "").encode().lower().split()), 1]


def shard_of(u: np.ndarray, w: np.ndarray, shards: int) -> np.ndarray:
    spread = (w % np.uint64(max(SPREAD, shards // 8))) * np.uint64(0x9E3779B9)
    return ((((u >> np.uint64(32)) + spread) & np.uint64(0xFFFFFFFF)) * np.uint64(shards)) >> np.uint64(32)


def word_shard(w: np.ndarray, shards: int) -> np.ndarray:
    return ((w >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def key_of(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """64 bits of a hash of both words."""
    with np.errstate(over="ignore"):
        x = u * np.uint64(0x9E3779B97F4A7C15) + ((w << np.uint64(31)) | (w >> np.uint64(33)))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def slices(sorted_shards: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(shard, start, end) of each run."""
    if len(sorted_shards):
        cut = np.flatnonzero(np.append(True, sorted_shards[1:] != sorted_shards[:-1]))
        yield from zip(sorted_shards[cut].astype(int).tolist(), cut.tolist(), np.append(cut[1:], len(sorted_shards)).tolist(), strict=True)


# --- counting


def packed_bigrams(texts: list[str | None], shards: int) -> Iterator[tuple[int, bytes]]:
    vocabulary = Vocabulary()
    ids = [np.array(numbers_of(t, vocabulary), np.uint64) for t in texts]
    pairs = np.concatenate([(x[:-1] << np.uint64(32)) | x[1:] for x in ids])
    pairs, counts = np.unique(pairs, return_counts=True)
    h = vocabulary.hashes()
    left = (pairs >> np.uint64(32)).astype(np.intp)
    u, w = h[left], h[(pairs & np.uint64(0xFFFFFFFF)).astype(np.intp)]
    shard = shard_of(u, w, shards).astype(np.uint32)
    order = np.argsort(shard, kind="stable")  # pairs of a context stay together
    u, w, counts, shard = u[order], w[order], counts[order], shard[order]
    for s, a, b in slices(shard):
        own = u[a:b]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        yield s, dump(own[first], narrow(np.diff(np.append(first, b - a))), w[a:b], narrow(counts[a:b]))


def summed_bigrams(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (u, w) in order with their counts."""
    us, ws, cs = [], [], []
    for blob in blobs:
        u, follow, w, c = load(blob)
        us.append(np.repeat(u, follow))
        ws.append(w)
        cs.append(c.astype(np.int64))
    u, w, c = np.concatenate(us), np.concatenate(ws), np.concatenate(cs)
    order = np.lexsort((w, u))
    u, w, c = u[order], w[order], c[order]
    first = np.flatnonzero(np.append(True, (u[1:] != u[:-1]) | (w[1:] != w[:-1])))
    return u[first], w[first], np.add.reduceat(c, first)


def counts_of_counts(c: np.ndarray) -> list[int]:
    return [int((c == k).sum()) for k in (1, 2, 3, 4)]


def save(folder: str, kind: str, shard: int, data: bytes) -> str:
    fs, base = open_folder(folder)
    fs.create_dir(base, recursive=True)
    name = f"{kind}-{shard:05d}-{uuid.uuid4().hex}"
    with fs.open_output_stream(f"{base}/{name}") as f:
        f.write(data)
    return name


@dataclass(frozen=True)
class Model:
    """Where the files are, in order of shards, and the sums that all workers need."""

    folder: str
    shards: int
    word_shards: int
    bigram_files: tuple[tuple[int, str], ...]
    word_files: tuple[tuple[int, str], ...]
    tokens: int
    words: int
    types: int
    discounts: tuple[float, float, float]
    lower: tuple[float, float, float]
    lower_types: tuple[int, int, int]


def drop_model(spark: SparkSession, model: Model) -> None:
    """Deletes a model's files, once nothing will be scored by it again."""
    remove(spark, model.folder)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of types that occur once to four times; 0.5, 1 and 1.5 where these can't tell."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.0
    found = [k - (k + 1) * y * b / a if a else k / 2 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(x, 0.1), k - 0.1) for k, x in zip((1, 2, 3), found, strict=True))


def count_model(docs: DataFrame, *, text_col: str = "text", shards: int | None = None, folder: str | None = None) -> Model:
    """Counts the bigrams of docs and writes the model's files to folder (a new one in the shared folder by default)."""
    spark = docs.sparkSession
    prepare(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if not shards:
        size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0  # one number
        shards = max(3 * parts, -(-size // SHARD_BYTES))
    word_shards = max(1, min(shards, parts), shards // 4)
    folder = folder or scratch_path(spark, "ngrams")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            for s, blob in packed_bigrams(held, shards):
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([blob], pa.binary())], names=["shard", "data"])
            held, size = [], 0

        for b in batches:
            for t in b.column(0).to_pylist():
                held.append(t)
                size += 2 + (len(t) // 6 if t else 0)
                if size >= SUM_TOKENS:
                    yield from flush()
        if held:
            yield from flush()

    def bigrams(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        u, w, c = summed_bigrams(table.column("data").to_pylist())
        keys = key_of(u, w)
        order = np.argsort(keys)
        name = save(folder, "bigrams", shard, dump(keys[order], narrow(c[order])))
        first = np.flatnonzero(np.append(True, u[1:] != u[:-1]))
        contexts = [u[first], np.add.reduceat(c, first), *(np.add.reduceat(x.astype(np.int64), first) for x in (c == 1, c == 2, c >= 3))]
        by_word = np.argsort(w, kind="stable")
        w, cw = w[by_word], c[by_word]
        first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
        followers = [w[first], np.diff(np.append(first, len(w))), np.add.reduceat(cw, first)]
        rows = [(shard % word_shards, 0, struct.pack("<6q", shard, len(u), *counts_of_counts(c)) + name.encode())]
        for kind, (h, *values) in ((1, contexts), (2, followers)):
            rows += [(s, kind, dump(h[a:b], *(narrow(x[a:b]) for x in values))) for s, a, b in slices(word_shard(h, word_shards))]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["shard", "kind", "data"])

    def words(table: pa.Table) -> pa.Table:
        shard, kinds, data = table.column("shard")[0].as_py(), table.column("kind").to_pylist(), table.column("data").to_pylist()
        out = []
        for kind, blob in zip(kinds, data, strict=True):
            if kind == 0:
                number, types, *n = struct.unpack_from("<6q", blob)
                out.append(("bigrams", number, blob[48:].decode(), types, 0, 0, *n))
        parts: dict[int, list[list[np.ndarray]]] = {1: [], 2: []}
        for kind, blob in zip(kinds, data, strict=True):
            if kind:
                parts[kind].append(load(blob))
        if parts[1] or parts[2]:
            h = np.unique(np.concatenate([x[0] for own in parts.values() for x in own]))
            total, n1, n2, n3, types, count = (np.zeros(len(h), np.int64) for _ in range(6))
            for sums, own in (((total, n1, n2, n3), parts[1]), ((types, count), parts[2])):
                for x, *values in own:  # distinct within a part
                    at = np.searchsorted(h, x)
                    for s, v in zip(sums, values, strict=True):
                        s[at] += v
            name = save(folder, "words", shard, dump(h, *map(narrow, (count, types, total, n1, n2, n3))))
            out.append(("words", shard, name, int(types.sum()), int(count.sum()), int((count > 0).sum()), *counts_of_counts(types)))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 7), strict=True)], names=MANIFEST)

    packed = map_arrow(docs.select(F.col(text_col).alias("text")), pack, "shard int, data binary")
    counted = packed.groupBy("shard").applyInArrow(bigrams, "shard int, kind int, data binary")
    manifest = counted.groupBy("shard").applyInArrow(words, "kind string, shard long, name string, types long, tokens long, words long, n1 long, n2 long, n3 long, n4 long")
    written = materialize(manifest, "ngram-manifest")
    rows = written.orderBy("kind", "shard").collect()  # a row for each shard
    forget(written)
    two, one = ([r for r in rows if r.kind == k] for k in ("bigrams", "words"))
    n, m = ([sum(r[f"n{k}"] for r in own) for k in (1, 2, 3, 4)] for own in (two, one))
    follower_types = sum(r.words for r in one)
    return Model(folder, shards, word_shards, tuple((r.shard, r.name) for r in two), tuple((r.shard, r.name) for r in one), sum(r.tokens for r in one), follower_types, sum(r.types for r in two), discounts(n), discounts(m), (m[0], m[1], follower_types - m[0] - m[1]))


MANIFEST = ["kind", "shard", "name", "types", "tokens", "words", "n1", "n2", "n3", "n4"]


# --- scoring


class Mapped:
    """A model's files, memory-mapped when they are needed. Files in a folder that isn't mounted are copied to the worker's own folder first."""

    _open: dict[str, Mapped] = {}

    @classmethod
    def of(cls, model: Model) -> Mapped:
        if model.folder not in cls._open:
            cls._open.clear()
            cls._open[model.folder] = cls(model)
        return cls._open[model.folder]

    def __init__(self, model: Model):
        self.model = model
        self.fs, self.base = open_folder(model.folder)
        self.bigram_files, self.word_files = dict(model.bigram_files), dict(model.word_files)
        self.arrays: dict[str, list[np.ndarray]] = {}

    def read(self, name: str) -> list[np.ndarray]:
        """The arrays of a file: keys in order, then what belongs to them."""
        if name not in self.arrays:
            if isinstance(self.fs, pafs.LocalFileSystem):
                self.arrays[name] = load(np.memmap(f"{self.base}/{name}", np.uint8, "r"))
            else:
                with tempfile.NamedTemporaryFile(prefix="ngrams-") as to:  # the map outlives the name
                    with self.fs.open_input_stream(f"{self.base}/{name}") as f:
                        shutil.copyfileobj(f, to)
                    to.flush()
                    self.arrays[name] = load(np.memmap(to.name, np.uint8, "r"))
        return self.arrays[name]

    def word_rows(self, h: np.ndarray) -> list[np.ndarray]:
        """count, types, total, n1, n2, n3 of hashes in any order; zeros where unknown."""
        out = [np.zeros(len(h), np.int64) for _ in range(6)]
        order = np.argsort(h)
        own = h[order]
        for s, a, b in slices(word_shard(own, self.model.word_shards)):
            if s in self.word_files:
                keys, *values = self.read(self.word_files[s])
                at = np.minimum(np.searchsorted(keys, own[a:b]), len(keys) - 1)
                hit = np.flatnonzero(keys[at] == own[a:b])
                for o, v in zip(out, values, strict=True):
                    o[order[a:b][hit]] = v[at[hit]]
        return out

    def bigram_counts(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Counts of the bigrams of word hashes."""
        out = np.zeros(len(u), np.int64)
        shard, keys = shard_of(u, w, self.model.shards), key_of(u, w)
        order = np.lexsort((keys, shard))
        keys = keys[order]
        for s, a, b in slices(shard[order]):
            if s in self.bigram_files:
                own, counts = self.read(self.bigram_files[s])
                at = np.minimum(np.searchsorted(own, keys[a:b]), len(own) - 1)
                hit = own[at] == keys[a:b]
                out[order[a:b][hit]] = counts[at[hit]]
        return out

    def score(self, texts: list[str | None]) -> list[np.ndarray]:
        """n_tokens, n_known, base_score, score, n_unseen, n_once of each text."""
        m = self.model
        vocabulary = Vocabulary()
        ids = [np.array(numbers_of(t, vocabulary), np.uint64) for t in texts]
        owner = np.repeat(np.arange(len(ids)), [len(x) - 1 for x in ids])
        pairs = np.concatenate([(x[:-1] << np.uint64(32)) | x[1:] for x in ids])
        pairs, inverse = np.unique(pairs, return_inverse=True)
        left, right = (pairs >> np.uint64(32)).astype(np.intp), (pairs & np.uint64(0xFFFFFFFF)).astype(np.intp)
        h = vocabulary.hashes()
        count, types, total, n1, n2, n3 = self.word_rows(h)
        count[0] = types[0] = 0  # the start is a context only
        base = np.log10((count + 0.5) / (m.tokens + 0.5 * (m.words + 1)))
        take = lambda d, c: np.choose(np.minimum(c, 3), (0.0, *d))
        rest = sum(d * n for d, n in zip(m.lower, m.lower_types, strict=True))
        q = (types - take(m.lower, types) + rest / (m.words + 1)) / m.types if m.types else np.ones(len(h))
        c = self.bigram_counts(h[left], h[right])
        t = np.maximum(total, 1)[left]
        share = np.where(total > 0, (m.discounts[0] * n1 + m.discounts[1] * n2 + m.discounts[2] * n3) / np.maximum(total, 1), 1.0)[left]
        p = np.log10((c - take(m.discounts, c)) / t + share * q[right])
        n = len(texts)
        tokens = np.bincount(owner, minlength=n)
        sum_ = lambda x: np.bincount(owner, x[inverse], n)
        return [tokens, sum_((count > 0)[right]).astype(np.int64), sum_(base[right]), sum_(p), sum_(c == 0).astype(np.int64), sum_(c == 1).astype(np.int64)]


def score(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """Columns of docs but the text, with n_tokens, n_known, train_tokens, base_score, score (log10), perplexity, n_unseen and n_once. No shuffle.

    n_unseen, n_once: tokens that follow the word before them nowhere, or in one place, of the training texts. A text that was learned
    from twice has neither.
    """
    keep = [c for c in docs.columns if c != text_col and c not in COLUMNS]
    own = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapped = Mapped.of(model)
        for b in batches:
            texts = b.column(len(keep)).to_pylist()
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size < SCORE_TOKENS):
                    size += 2 + (len(texts[end]) // 6 if texts[end] else 0)
                    end += 1
                tokens, known, base, p, unseen, once = mapped.score(texts[at:end])
                part = b.slice(at, end - at)
                found = [pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(tokens), model.tokens), pa.int64()), pa.array(base), pa.array(p), pa.array(10 ** np.minimum(-p / tokens, 300)), pa.array(unseen, pa.int64()), pa.array(once, pa.int64())]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *found], names=[*keep, *COLUMNS])
                at = end

    kinds = "".join(f"`{n}` {t}, " for n, t in own.dtypes[:-1])
    return map_arrow(own, run, f"{kinds}n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double, n_unseen long, n_once long")
