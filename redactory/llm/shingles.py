"""Links of texts whose sets of word shingles are alike, for what a SimHash of 64 bits can't tell apart from chance.

A Jaccard similarity of 0.8 changes about 10 of a SimHash's 64 bits, far beyond any error budget that an index can serve. So texts also
get 64 min-hashes of their shingles: bands of 4 propose groups, and the share of equal min-hashes (one byte each) proposes links within
a group. A group gives one link per member to the first of its class, never its pairs; members that are linked already are not compared
again, so a group of copies costs a pass over it. Rows of bands that nobody shares go no further than one narrow shuffle. A group of more
than GROUP members is dealt by pairs of its blocks, of which every two members meet in one: no task holds more than two blocks.

What is proposed is confirmed exactly: the texts of a proposed class meet once, in blocks of BLOCK texts of which every two come together
in a task, and are linked where the Jaccard similarity of their shingle sets is large enough. A chain of loose links thus only decides
which texts are compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactory.llm.arrow import map_arrow
from redactory.session import materialize

HASHES, BAND = 64, 4
#: Members of a block of a band's group.
GROUP = 2048
#: Texts of a block; a task holds the shingle sets of two blocks at most.
BLOCK = 512
#: Odd factors and offsets of the hash functions, from a fixed seed.
_RNG = np.random.default_rng(42)
FACTORS = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)


def min_hashes(hashes: np.ndarray) -> np.ndarray:
    """HASHES minima (uint32) over the hashes (uint64) of a text's shingles."""
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(hashes), 2048):
        own = (hashes[i : i + 2048, None] * FACTORS[None] + OFFSETS[None]) >> np.uint64(32)
        low = np.minimum(low, own.min(axis=0).astype(np.uint32))
    return low


def bands_of(low: np.ndarray) -> np.ndarray:
    """A hash (int64) of each band and its number."""
    x = np.arange(1, HASHES // BAND + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for part in low.reshape(-1, BAND).T.astype(np.uint64):
        x = (x ^ part) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
    return x.view(np.int64)


def alike_classes(rows: np.ndarray, least: float) -> np.ndarray:
    """Labels (index of a member) of rows (n, HASHES) whose share of equal bytes is at least `least`, linked or by a chain of links."""
    n = len(rows)
    label = np.arange(n)
    left = np.arange(n)
    while len(left):
        queue, left = [int(left[0])], left[1:]
        root = queue[0]
        while queue and len(left):
            near = (rows[left] == rows[queue.pop()]).mean(axis=1) >= least
            found = left[near]
            if len(found):
                label[found] = root
                left = left[~near]
                queue += found.tolist()
    return label


def jaccard_classes(sets: list[np.ndarray], rows: np.ndarray, least: float, similarity: float) -> np.ndarray:
    """Labels (index of a member) of sets (sorted, distinct) with a Jaccard similarity of at least `similarity`, linked or by a chain of links.

    Only sets of which the share of equal bytes in rows (n, HASHES) is at least `least` and the sizes allow it are compared.
    """
    label, size = np.arange(len(sets)), np.array([len(x) for x in sets])
    left = np.arange(len(sets))
    while len(left):
        queue, left = [int(left[0])], left[1:]
        root = queue[0]
        while queue and len(left):
            x = queue.pop()
            near = (rows[left] == rows[x]).mean(axis=1) >= least
            near &= np.minimum(size[left], size[x]) >= similarity * np.maximum(size[left], size[x]) - 1e-9
            for at in np.flatnonzero(near).tolist():
                y = left[at]
                both = int(np.isin(sets[x], sets[y], assume_unique=True).sum())
                either = int(size[x] + size[y]) - both
                near[at] = not either or both / either >= similarity
            found = left[near]
            if len(found):
                label[found] = root
                left = left[~near]
                queue += found.tolist()
    return label


def shared_bands(reps: DataFrame) -> DataFrame:
    """(key, value, block) of the bands (key, bands) that several have, and (null, value, number of blocks) of those of several blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come in order of their band; the last row waits for the next batch
        last_key, last_value, several, at = None, None, False, 0

        def rows(key: np.ndarray, value: np.ndarray, block: np.ndarray, blocks: list[tuple[int, int]]) -> pa.RecordBatch:
            names = [pa.array(key, pa.int64()), pa.nulls(len(blocks), pa.int64())], [pa.array(value, pa.int64()), pa.array([v for v, _ in blocks], pa.int64())], [pa.array(block, pa.int32()), pa.array([n for _, n in blocks], pa.int32())]
            return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in names], names=["key", "value", "block"])

        for b in batches:
            key, value = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(key):
                continue
            if last_value is not None:
                key, value = np.append(last_key, key), np.append(last_value, value)
            same = value[1:] == value[:-1]
            keep = np.append(several, same) | np.append(same, False)
            keep[-1] = False
            # a row's place in its group; the first row's is known from before
            edge = np.flatnonzero(np.append(True, ~same))
            place = np.arange(len(key)) - np.repeat(edge, np.diff(np.append(edge, len(key))))
            place[: edge[1] if len(edge) > 1 else len(key)] += at
            done = np.append(edge[1:] - 1, [])  # the last rows of groups that end here
            ends = done[place[done.astype(int)] >= GROUP].astype(int)
            yield rows(key[keep], value[keep], place[keep] // GROUP, [(int(value[i]), int(place[i]) // GROUP + 1) for i in ends])
            several = bool(same[-1]) if len(same) else several
            last_key, last_value, at = key[-1], value[-1], int(place[-1])
        if last_value is not None and several:
            yield rows(np.array([last_key]), np.array([last_value]), np.array([at // GROUP]), [(int(last_value), at // GROUP + 1)] if at >= GROUP else [])

    rows = reps.select("key", F.explode("bands").alias("value"))
    return map_arrow(rows.repartition("value").sortWithinPartitions("value"), run, "key long, value long, block int")


def by_pairs_of_blocks(rows: DataFrame) -> DataFrame:
    """rows (with n, the blocks of a group, and own, a row's block) as often as its block meets another: low and high name the two."""
    others = F.when(F.col("n") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda j: j != F.col("own")))
    return rows.withColumn("other", F.explode(others)).withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("other")


def alike_links(reps: DataFrame, least: float, made: list[DataFrame] | None = None) -> DataFrame:
    """a, b: links of reps (key, bands, signature) with a share of equal min-hashes of at least `least`; they only propose. made: takes the tables that they are read from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def ready(all_of_it: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            key, group, rows = (np.concatenate(x) for x in zip(*held, strict=True))
            edge = np.flatnonzero(np.append(True, (group[1:] != group[:-1]).any(axis=1)))
            end = len(key) if all_of_it else int(edge[-1])
            a, b = [], []
            for i, j in zip(edge, np.append(edge[1:], len(key)), strict=True):
                if j <= end and j - i > 1:
                    label = alike_classes(rows[i:j], least) + i
                    own = np.flatnonzero(label != np.arange(i, j)) + i
                    a.append(key[own])
                    b.append(key[label[own - i]])
            held = [(key[end:], group[end:], rows[end:])]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

        for b in batches:
            rows = np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint8).reshape(-1, HASHES)
            held.append((b.column(3).to_numpy(), np.stack([b.column(i).to_numpy() for i in range(3)], axis=1), rows))
            if sum(len(x[0]) for x in held) >= 20_000:
                yield from ready(False)
        if held:
            yield from ready(True)

    shared = materialize(shared_bands(reps), "shared-bands")
    if made is not None:
        made.append(shared)
    members = shared.where("key IS NOT NULL").join(reps.select("key", "signature").hint("merge"), "key")
    large = shared.where("key IS NULL").select("value", F.col("block").alias("n"))  # one row for GROUP members at least
    placed = members.join(large, "value", "left").withColumns({"own": F.when(F.col("n").isNull(), 0).otherwise(F.col("block")), "n": F.coalesce("n", F.lit(1))})
    dealt = by_pairs_of_blocks(placed).select("value", "low", "high", "key", "signature").repartition("value", "low", "high").sortWithinPartitions("value", "low", "high", "key")
    return map_arrow(dealt, run, "a long, b long")


def confirmed_links(texts: DataFrame, classes: DataFrame, shingles: Callable[[str], np.ndarray], least: float, similarity: float, made: list[DataFrame] | None = None) -> DataFrame:
    """a, b: links that connect every two texts of a proposed class with a Jaccard similarity of at least `similarity`, and no others.

    texts: doc_id, key, text, with repeats; classes: key, root, doc_id (of a row that has the text), signature; made: takes the tables that
    the links are read from.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple[int, np.ndarray, bytes]] = []
        here = None

        def links() -> pa.RecordBatch:
            keys = np.array([k for k, _, _ in group], np.int64)
            rows = np.frombuffer(b"".join(x for _, _, x in group), np.uint8).reshape(-1, HASHES)
            label = jaccard_classes([x for _, x, _ in group], rows, least, similarity)
            own = np.flatnonzero(label != np.arange(len(keys)))
            return pa.RecordBatch.from_arrays([pa.array(keys[own]), pa.array(keys[label[own]])], names=["a", "b"])

        # rows come in order of group and key; a text may come more than once
        for b in batches:
            for root, low, high, key, signature, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (root, low, high) != here:
                    if len(group) > 1:
                        yield links()
                    group, here = [], (root, low, high)
                if not group or group[-1][0] != key:
                    group.append((key, np.unique(shingles(text or "")), signature))
        if len(group) > 1:
            yield links()

    # a class of more than BLOCK texts is dealt by pairs of its blocks; such classes are found first, so that no class meets them in one task
    large = materialize(classes.groupBy("root").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("n")).where("n > 1"), "large-classes")
    if made is not None:
        made.append(large)
    placed = classes.join(large, "root", "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("own", F.when(F.col("n") == 1, 0).otherwise(F.pmod(F.xxhash64("key"), "n").cast("int")))
    found = texts.join(placed.withColumnRenamed("key", "__key").withColumnRenamed("doc_id", "__id").hint("merge"), (F.col("key") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    dealt = by_pairs_of_blocks(found.select("root", "n", "own", "key", "signature", "text")).select("root", "low", "high", "key", "signature", "text")
    return map_arrow(dealt.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high", "key"), run, "a long, b long")
