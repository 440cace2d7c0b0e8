"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z: runs of digits, letters and all that isn't ASCII. A window is
`size` consecutive words of a benchmark item; an item of fewer words, but not none, is one window of all of them. The symbols of the
search are words. For windows of one length m, the shift table has for each block of two words (one, if m is 1) the least distance
from its end to a window's end; a block that is in no window shifts by m - 1 (m, if m is 1). Where the shift is zero, the hash of the
last words selects a bucket of windows, which are compared word by word.

The benchmark is cut into blocks of whole items, each about `block_bytes` of text (an item that is larger is a block of its own), and
each block is broadcast by itself. Documents are searched in one map: a task holds some CHUNK_BYTES of text, searches it for one block
after another, and has the tables of one block at a time. So neither the plan nor a worker's memory grows with the benchmark. With one
block, its tables are kept between batches. Hits are intervals of word positions in the row; there is no shuffle.

Defined cases: null texts have no words; null or wordless items have no windows; an item id that occurs in several rows counts once;
items with a null id mark words as hit but are in neither n_items nor items_sha256; no items give sha256 of the empty string; equal
windows of several items count for all of them; an empty benchmark leaves all documents clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactory.llm.arrow import prepare, texts_of

#: A-Z to a-z; digits, a-z and all bytes of other characters stay; the rest separates words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
SUFFIX = 4
#: Text that a task holds while it searches for several blocks.
CHUNK_BYTES = 32 << 20


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split()


class WuManber:
    """Windows of one length over words, with their shift table and suffix buckets."""

    def __init__(self, length: int, windows: dict[tuple[bytes, ...], list]):
        self.m, self.b = length, min(2, length)
        self.windows = windows
        self.default = length - self.b + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.suffix = min(SUFFIX, length)
        self.buckets: dict[int, list[tuple[bytes, ...]]] = {}
        for w in windows:
            for end in range(self.b, length + 1):
                block = w[end - self.b : end]
                self.shift[block] = min(length - end, self.shift.get(block, self.default))
            self.buckets.setdefault(hash(w[length - self.suffix :]), []).append(w)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, int, list]]:
        """(first word, past the last word, items) of each occurrence."""
        m, n, s = self.m, len(words), self.suffix
        shift, default, buckets, windows = self.shift.get, self.default, self.buckets.get, self.windows
        i = m
        if m == 1:
            for i, w in enumerate(words):
                if (w,) in windows:
                    yield i, i + 1, windows[(w,)]
            return
        while i <= n:
            step = shift((words[i - 2], words[i - 1]), default)
            if step:
                i += step
                continue
            if bucket := buckets(hash(tuple(words[i - s : i]))):
                own = tuple(words[i - m : i])
                for w in bucket:
                    if w == own:
                        yield i - m, i, windows[w]
            i += 1


def matchers(items: list[tuple[object, str]], size: int) -> list[WuManber]:
    by_length: dict[int, dict[tuple[bytes, ...], list]] = {}
    for item_id, text in items:
        words = words_of(text)
        m = min(size, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            owners = by_length.setdefault(m, {}).setdefault(tuple(words[i : i + m]), [])
            if item_id not in owners:
                owners.append(item_id)
    return [WuManber(m, w) for m, w in sorted(by_length.items())]


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_BUILT: dict[object, list[WuManber]] = {}


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str | None, str]]]:
    """The items in blocks of bounded size, read one partition at a time."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("t is not null")
    held, size = [], 0
    for r in rows.toLocalIterator():
        if held and size + len(r.t) + 64 > block_bytes:
            yield held
            held, size = [], 0
        held.append((r.i, r.t))
        size += len(r.t) + 64
    if held:
        yield held


def count_words(text):
    """Number of words of a text column."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.size(F.array_remove(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")).cast("long")


def find_windows(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 10, block_bytes: int = 4 << 20) -> DataFrame:
    """docs with __words (long), __spans (hit words as intervals of word positions) and __items (ids as strings, each once)."""
    prepare(spark := docs.sparkSession)
    names = docs.columns
    out = docs.withColumns({"__words": F.lit(0).cast("long"), "__spans": F.array().cast("array<struct<a:long,b:long>>"), "__items": F.array().cast("array<string>")})
    schema, at = out.schema, names.index(text_col)
    blocks = [spark.sparkContext.broadcast(items) for items in blocks_of(benchmark, item_col, item_text_col, block_bytes)]
    if not blocks:  # no items: only words are counted
        return out.withColumn("__words", count_words(F.col(text_col)))

    def of_block(number: int) -> list[WuManber]:
        shared = blocks[number]
        key = (shared._path or id(shared), size)  # the file that the worker has of this broadcast
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = matchers(shared.value, size)
            if len(blocks) > 1 and shared._path:
                shared.__dict__.pop("_value", None)  # it is read again from that file
        return _BUILT[key]

    def searched(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same: dict[bytes, bytes] = {}
        words = [[same.setdefault(w, w) for w in words_of(t)] for b in held for t in texts_of(b.column(at))]
        spans: list[list[tuple[int, int]]] = [[] for _ in words]
        found: list[set] = [set() for _ in words]
        for number in range(len(blocks)):
            for m in of_block(number):
                for own, hits, who in zip(words, spans, found, strict=True):
                    for first, past, owners in m.search(own):
                        if hits and hits[-1][0] <= first <= hits[-1][1]:
                            hits[-1] = (hits[-1][0], max(past, hits[-1][1]))
                        else:
                            hits.append((first, past))
                        who.update(x for x in owners if x is not None)
        low = 0
        for b in held:
            n = b.num_rows
            rows = slice(low, low + n)
            low += n
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(map(len, words[rows]), pa.int64(), size=n), pa.array([[{"a": x, "b": y} for x, y in union(own)] for own in spans[rows]], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array([sorted(x) for x in found[rows]], pa.list_(pa.string()))], names=b.schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size_ = [], 0
        for b in batches:
            held.append(b)
            size_ += b.column(at).nbytes
            if len(blocks) == 1 or size_ >= CHUNK_BYTES:
                yield from searched(held)
                held, size_ = [], 0
        if held:
            yield from searched(held)

    return out.mapInArrow(run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_windows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark, **options)
    n_hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"])
    return found.select("doc_id", F.col("__words").alias("n_words"), n_hit.alias("n_hit"), F.size("__items").cast("long").alias("n_items"), F.sha2(F.array_join("__items", ","), 256).alias("items_sha256")).withColumn("contaminated", F.col("n_hit") > 0)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without those that contain a window of the benchmark. Columns that are named as those of find_windows are kept."""
    clash = {c: f"__in_{c}" for c in docs.columns if c in ("__words", "__spans", "__items")}
    text = options.pop("text_col", "text")
    found = find_windows(docs.withColumnsRenamed(clash), benchmark, text_col=clash.get(text, text), **options).where(F.size("__spans") == 0)
    return found.select(*(F.col(f"`{clash.get(c, c)}`").alias(c) for c in docs.columns))


ORACLE_SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), iw AS (
  SELECT item_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE text IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT m FROM windows),
grams AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, lengths WHERE len(w) >= m)
), hits AS (SELECT doc_id, grams.m, i, item_id FROM grams JOIN windows ON grams.g = windows.g AND grams.m = windows.m),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(items.l, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
