"""SimHash near-duplicates by binary trie self-joins.

Fingerprint: a document's words `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z give shingles of `width` words; bit k is 1 if it is set in
over half of the shingles' XXH64 hashes (seed 42).

Links: distinct fingerprints within `budget` differing bits. The 64 bits are cut into budget + k blocks, so two linked fingerprints
agree in k whole blocks at least; for each choice of k blocks the fingerprints that agree there form a group, which is one subtree of
a trie whose first levels are those blocks. k follows the number of distinct fingerprints, so that groups stay small; every choice of
k finds the same links. A group above `group_limit` is split again by the same argument on its remaining bits until it is small or so
few bits are left that all its members are linked. Within a group the trie is joined with itself: pairs of nodes descend together, differing bits add up, pairs above the
budget are dropped, and so are pairs whose leaves are all linked already. A group returns one link per member to the smallest of its
local class, never its pairs. Classes over all groups come from rounds of minimum labels and pointer jumping over tables in the shared
folder.

Defined cases: null and empty texts and texts without words have fingerprint zero and link like others; fewer words than `width` make
one shingle of all; equal rows have equal fingerprints; a row with null id takes part in links but no class is named by it (component_id
is null where no member has an id); an empty table gives no rows; columns of other names are ignored or, in near_dedup, kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactory.llm.arrow import map_arrow, texts_of
from redactory.llm.shingles import alike_links, bands_of, confirmed_links, min_hashes
from redactory.session import forget, materialize

BITS = 64


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 (uint64) of each shingle, repeats included; none if there are no words."""
    words = text.encode().lower().split()
    joined, hash_ = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([hash_(joined, 42)] if words else [], "<u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.append(0, ends[:-1])
    return np.array([hash_(joined[a:b], 42) for a, b in zip(starts[: len(words) - width + 1].tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)], "<u8")


def majority(h: np.ndarray) -> int:
    """The fingerprint of shingle hashes."""
    set_ = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 255):  # counts of a slice fit in a byte
        set_ += np.unpackbits(h[i : i + 255].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * set_ > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str, width: int) -> int:
    return majority(shingle_hashes(text, width))


def text_key(text_col: str):
    """A hash of a text; null is as empty."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, keyed: bool = False, signed: bool = False) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long); if keyed, then key of the text; if signed, also bands and signature of the shingles. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = [shingle_hashes(t, width) for t in texts_of(b.column(1))]
            columns = [b.column(0), pa.array(np.array([majority(h) for h in hashes], "<u8").view("<i8")), *b.columns[2:]]
            if signed:
                low = [min_hashes(h) for h in hashes]
                columns += [pa.array([bands_of(x) if len(h) else [] for x, h in zip(low, hashes, strict=True)], pa.list_(pa.int64())), pa.array([x.astype(np.uint8).tobytes() for x in low], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "fp", *(["key"] if keyed else []), *(["bands", "signature"] if signed else [])]
    kind = docs.select(id_col).dtypes[0][1]
    kinds = {"doc_id": kind, "fp": "long", "key": "long", "bands": "array<long>", "signature": "binary"}
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *([text_key(text_col).alias("key")] if keyed else []))
    return map_arrow(own, run, ", ".join(f"{n} {kinds[n]}" for n in names))


# --- the join of a sorted forest of tries with itself


def _roots(labels: np.ndarray) -> np.ndarray:
    while not np.array_equal(up := labels[labels], labels):
        labels = up
    return labels


def _join(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (least index of a class) after linking a[i] with b[i]."""
    while True:
        x, y = labels[a], labels[b]
        if not (apart := x != y).any():
            return labels
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        labels = labels.copy()
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        labels = _roots(labels)


def trie_classes(keys: np.ndarray, group: np.ndarray, budget: int, most: int = 1 << 18) -> np.ndarray:
    """Labels of linked fingerprints: keys (uint64, distinct in a group) in order within each group, groups one after another.

    A node of a trie is a range of the sorted keys. The front holds pairs of nodes of one level with their differing bits so far; all
    are moved down one level at once, and a front above `most` pairs is halved and finished one half after the other.
    """
    n = len(keys)
    labels = np.arange(n)
    if n < 2:
        return labels
    # neighbours in order within the budget are linked at once; the rest of a dense group is then mostly pruned
    close = np.flatnonzero((group[1:] == group[:-1]) & (np.bitwise_count(keys[1:] ^ keys[:-1]) <= budget))
    labels = _join(labels, close, close + 1)
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    last = np.append(first[1:], n)
    many = last - first > 1
    first, last = first[many], last[many]
    waiting = [(BITS - 1, first, last, first, last, np.zeros(len(first), np.int8))]
    while waiting:
        bit, a0, a1, b0, b1, off = waiting.pop()
        if len(a0) > most:
            h = len(a0) // 2
            waiting += [(bit, *(x[h:] for x in (a0, a1, b0, b1, off))), (bit, *(x[:h] for x in (a0, a1, b0, b1, off)))]
            continue
        # a node whose leaves have one label is even; pairs of even nodes with that label have nothing to add
        change = np.flatnonzero(np.append(labels[1:] != labels[:-1], True)) + 1
        run_end = change[np.searchsorted(change, np.arange(n), side="right")]
        live = ~((labels[a0] == labels[b0]) & (run_end[a0] >= a1) & (run_end[b0] >= b1))
        a0, a1, b0, b1, off = (x[live] for x in (a0, a1, b0, b1, off))
        if not len(a0):
            continue
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        if single.any():  # two leaves: their last bits are compared at once
            x, y = a0[single], b0[single]
            linked = (x != y) & (np.bitwise_count(keys[x] ^ keys[y]) <= budget)
            labels = _join(labels, x[linked], y[linked])
            rest = ~single
            a0, a1, b0, b1, off = (x[rest] for x in (a0, a1, b0, b1, off))
        if bit < 0 or not len(a0):
            continue
        ones = np.append(0, np.cumsum((keys >> np.uint64(bit)) & np.uint64(1)).astype(np.int64))
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])  # keys are in order: zeros, then ones
        own = (a0 == b0) & (a1 == b1)
        apart = off < budget
        parts = [(a0, am, b0, bm, off, np.ones(len(a0), bool)), (am, a1, bm, b1, off, np.ones(len(a0), bool)), (a0, am, bm, b1, off + 1, apart), (am, a1, b0, bm, off + 1, apart & ~own)]
        kept = [tuple(x[k & (p1 > p0) & (q1 > q0)] for x in (p0, p1, q0, q1, o)) for p0, p1, q0, q1, o, k in parts]
        waiting.append((bit - 1, *(np.concatenate(x) for x in zip(*kept, strict=True))))
    return labels


# --- groups


def cut(bits: list[int], n: int) -> list[list[int]]:
    """bits in n blocks of nearly equal size."""
    return [list(map(int, x)) for x in np.array_split(bits, n)]


def _field(fp, bits: list[int]):
    """The value of some bits of a fingerprint, as a long."""
    runs: list[list[int]] = []
    for b in bits:
        if runs and runs[-1][-1] == b - 1:
            runs[-1].append(b)
        else:
            runs.append([b])
    out, at = F.lit(0).cast("long"), 0
    for run in runs:
        part = F.shiftrightunsigned(fp, run[0]).bitwiseAND(F.lit((1 << len(run)) - 1 if len(run) < 64 else -1))
        out, at = out.bitwiseOR(F.shiftleft(part, at)), at + len(run)
    return out


def agreeing(count: int, budget: int, size: int) -> int:
    """The least k for which groups that agree in k of budget + k blocks have about `size` members among evenly spread fingerprints."""
    k = 1
    while count > size * 2 ** (BITS * k / (budget + k)) and comb(budget + k + 1, k + 1) <= 256:
        k += 1
    return k


def keyed(rows: DataFrame, bits: list[int], blocks: int, agree: int, first: int = 0) -> tuple[DataFrame, dict[int, list[int]]]:
    """(fp, value) of each group that a fingerprint is in, and the bits that are left of each choice of blocks.

    rows: fp, under (what the group is part of). value: a hash of all that its members agree in, with the choice's number, from `first`
    on, in its last byte.
    """
    parts = cut(bits, blocks)
    choices = dict(enumerate(combinations(range(blocks), agree), first))
    if first + len(choices) > 256:
        raise ValueError("more choices of blocks than a byte tells apart")
    inside = {c: sum((parts[i] for i in chosen), []) for c, chosen in choices.items()}
    values = F.array(*(F.xxhash64("under", F.lit(c), _field(F.col("fp"), own)).bitwiseAND(F.lit(-256)).bitwiseOR(F.lit(c).cast("long")) for c, own in inside.items()))
    return rows.select("fp", F.explode(values).alias("value")), {c: [b for b in bits if b not in own] for c, own in inside.items()}


def group_links(groups: DataFrame, budget: int, limit: int, last: frozenset[int]) -> DataFrame:
    """fp, root, value. For each linked member of a group: the smallest of its class there. For each member of a group above limit: value.

    Groups of the choices in `last` are never above the limit: all their members are linked. One shuffle; a group is read in order and
    never held beyond the limit.
    """

    def rows(fp: np.ndarray, root: np.ndarray | None, value: np.ndarray | None) -> pa.RecordBatch:
        none = pa.nulls(len(fp), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(fp.view("<i8")), none if root is None else pa.array(root.view("<i8")), none if value is None else pa.array(value)], names=["fp", "root", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, "<u8"), np.zeros(0, "<i8"))
        over: int | None = None  # a group above the limit of which rows may still come
        first: dict[int, int] = {}  # the first member of a group of a last choice that is still open

        def ready(fp: np.ndarray, value: np.ndarray, end: int) -> Iterator[pa.RecordBatch]:
            edge = np.flatnonzero(np.append(True, value[1:end] != value[: end - 1])) if end else np.zeros(0, int)
            sizes = np.diff(np.append(edge, end))
            large = np.repeat(sizes > limit, sizes)
            if large.any():
                yield rows(fp[:end][large], None, value[:end][large])
            fp, group = fp[:end][~large], np.repeat(np.arange(len(edge)), sizes)[~large]
            if len(fp):
                labels = trie_classes(fp, group, budget)
                own = np.flatnonzero(labels != np.arange(len(fp)))
                yield rows(fp[own], fp[labels[own]], None)

        for b in batches:
            fp, value = b.column(0).to_numpy().view("<u8"), b.column(1).to_numpy()
            if last:
                whole = np.isin(value & 255, list(last))
                if whole.any():
                    f, v = fp[whole], value[whole]
                    edge = np.append(True, v[1:] != v[:-1])
                    if int(v[0]) in first:
                        edge[0] = False
                    roots = np.where(edge, f, 0)
                    start = np.uint64(first.get(int(v[0]), 0))
                    at = np.maximum.accumulate(np.where(edge, np.arange(len(f)), -1))
                    roots = np.where(at >= 0, f[np.maximum(at, 0)], start)
                    first = {int(v[-1]): int(roots[-1])}
                    yield rows(f[roots != f], roots[roots != f], None)
                    fp, value = fp[~whole], value[~whole]
            if over is not None:
                more = value == over
                if more.any():
                    yield rows(fp[more], None, value[more])
                    fp, value = fp[~more], value[~more]
                if len(value):
                    over = None
            held = (np.concatenate((held[0], fp)), np.concatenate((held[1], value)))
            if len(held[0]) >= 32_768:
                end = int(np.flatnonzero(held[1] != held[1][-1])[-1] + 1) if held[1][0] != held[1][-1] else 0
                yield from ready(*held, end)
                held = (held[0][end:], held[1][end:])
                if len(held[0]) > limit:
                    over = int(held[1][0])
                    yield rows(held[0], None, held[1])
                    held = (held[0][:0], held[1][:0])
        yield from ready(*held, len(held[0]))

    # unsigned order: the sign bit is turned for sorting
    dealt = groups.repartition("value").sortWithinPartitions("value", F.col("fp").bitwiseXOR(F.lit(-(1 << 63))))
    return map_arrow(dealt, run, "fp long, root long, value long")


def all_links(reps: DataFrame, budget: int, k: int, limit: int, made: list[DataFrame] | None = None) -> DataFrame:
    """a, b: links that connect every two fingerprints within the budget. made: takes the tables that they are read from.

    Groups above the limit are split by more of their bits, those of as many choices as a byte tells apart in one job: a level of
    splitting is a few jobs, however many groups it has.
    """
    found, open_ = [], [(reps.select("fp", F.lit(0).cast("long").alias("under")), list(range(BITS)), k)]
    while open_:
        groups, left, last = [], {}, set()
        while open_ and len(left) + comb(min(len(open_[0][1]), budget + open_[0][2]), open_[0][2]) <= 256:
            rows, bits, agree = open_.pop(0)
            own, inside = keyed(rows, bits, min(len(bits), budget + agree), agree, len(left))
            groups.append(own)
            left |= inside
            # with so few bits left, any two members of a group are within the budget
            last |= {c for c, rest in inside.items() if len(rest) <= budget}
        out = materialize(group_links(reduce(DataFrame.union, groups), budget, limit, frozenset(last)), "group-links")
        if made is not None:
            made.append(out)
        found.append(out.where("value IS NULL").select(F.col("fp").alias("a"), F.col("root").alias("b")))
        large = out.where("value IS NOT NULL")
        for r in large.select(F.col("value").bitwiseAND(F.lit(255)).alias("c")).distinct().orderBy("c").collect():  # 256 at most
            open_.append((large.where(F.col("value").bitwiseAND(F.lit(255)) == r.c).select("fp", F.col("value").alias("under")), left[r.c], 1))
    return reduce(DataFrame.union, found)


# --- classes


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root for all nodes of links (a, b): root is the least node (as a signed long) that can be reached.

    Each round gives every node the least label among itself and its neighbours, then the label of that label. Joins and sums are over
    keys that Spark splits or sums before shuffling; each round is a table in the shared folder, which is deleted when the next is there.
    """
    size, made = None, []
    for _ in range(2):  # the neighbours of a node are linked to the least of them instead: a dense class has few links then
        down = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        down = materialize(down, "links", size)
        forget(*made)
        size = 2 * down.count()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        links = materialize(down.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("l")).select("l.a", "l.b").where("a <> b").distinct(), "links", size)
        forget(down)
        made = [links]
    both = materialize(links.where("a <> b").select("a", "b").union(links.where("a <> b").select(F.col("b"), F.col("a"))).distinct(), "links", size)
    forget(*made)
    labels = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), "labels", size)
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        least = labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        least = materialize(least, "labels", size)
        jump = least.select(F.col("node").alias("root"), F.col("root").alias("up"))
        new = materialize(least.join(jump, "root", "left").select("node", F.least("root", "up").alias("root"), "was"), "labels", size)
        changed = new.where(F.col("root") < F.col("was")).limit(1).count()
        forget(labels, least)
        labels = new
        if not changed:
            forget(both)
            out = labels.select("node", "root")
            out._scratch = labels._scratch
            return out
    raise RuntimeError(f"classes did not settle in {most_rounds} rounds")


def simhash_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, budget: int = 4, group_size: int = 64, group_limit: int = 8192) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (least doc_id that is reachable)."""
    fps = materialize(fingerprints(docs, id_col=id_col, text_col=text_col, width=width), "fingerprints")
    reps = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(all_links(reps, budget, agreeing(reps.count(), budget, group_size), group_limit, made := []))
    forget(*made)
    placed = reps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(placed.select("fp", "root").join(least, "root").select("fp", "component_id"), "classes")
    forget(reps, roots)
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, budget: int = 4, group_size: int = 64, group_limit: int = 8192, alike: float | None = None, similarity: float = 0.8) -> DataFrame:
    """docs with one document of each class: the one with the least id, null last, and of that id the least hash of a text; of rows with both alike any.

    Rows are told apart by id and text, so rows without an id or with a shared one are lost only to a row of their own class.

    alike: if set, SimHash links and texts of which at least this share of min-hashes is equal are only proposed, and the classes are those
    of texts with a Jaccard similarity of shingles of at least `similarity` (see redactory.llm.shingles).
    """
    rows = materialize(fingerprints(docs, id_col=id_col, text_col=text_col, width=width, keyed=True, signed=alike is not None), "fingerprints")
    more = [F.min(F.struct("signature", "bands")).alias("s")] if alike is not None else []
    # ids in order, null last
    texts = materialize(rows.groupBy("key").agg(F.min("fp").alias("fp"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("least"), *more), "distinct-texts")
    prints = materialize(texts.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    near = all_links(prints, budget, agreeing(prints.count(), budget, group_size), group_limit, made := [])
    # fingerprints are nodes of their own, and texts are linked to theirs where it has other texts or links: no join is on the root of a class
    node = lambda fp: F.xxhash64(F.lit("fingerprint"), fp)
    linked = prints.where("n > 1").select("fp").union(near.select("a")).union(near.select("b")).distinct()
    links = near.select(node(F.col("a")).alias("a"), node(F.col("b")).alias("b")).union(texts.join(linked, "fp", "left_semi").select(F.col("key").alias("a"), node(F.col("fp")).alias("b")))
    if alike is not None:
        links = links.union(alike_links(texts.select("key", "s.bands", "s.signature"), alike, made))
    roots = components(links)
    forget(*made, prints)
    if alike is not None:
        own = docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("key"), F.col(text_col).alias("text"))
        proposed = roots.withColumnRenamed("node", "key").join(texts.select("key", F.col("least.doc_id").alias("doc_id"), "s.signature"), "key")
        loose, made = roots, []
        roots = components(confirmed_links(own, proposed, partial(shingle_hashes, width=width), alike, similarity, made))
        forget(loose, *made)
    placed = texts.select("key", "least").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    named = placed.groupBy("root").agg(F.min(F.struct("least", "key")).alias("l")).select(F.col("l.least.doc_id").alias("__id"), F.col("l.key").alias("__key"))
    times = rows.groupBy("key", "doc_id").count().where("count > 1")
    kept = materialize(named.join(times, (F.col("key") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left").select("__id", "__key", F.col("count").isNotNull().alias("__several")), "kept-texts")
    forget(rows, texts, roots)
    keyed = docs.withColumn("__own", text_key(text_col))
    match = keyed[id_col].eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__key"))
    # both sides grow with the documents: they are always merged, never broadcast
    out = keyed.join(kept.where(~F.col("__several")).hint("merge"), match).select(*(docs.columns))
    several = kept.where("__several")
    if several.limit(1).count():  # rows that share an id and a text: only these are shuffled once more
        out = out.union(keyed.join(several, match).dropDuplicates([id_col, "__own"]).select(*docs.columns))
    return out
