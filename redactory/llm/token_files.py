"""Token-id files with fixed-width bit packing.

Shard file (all integers little-endian): the 8 bytes of MAGIC; uint32 width (bits of an id, the fewest that hold the vocabulary),
uint32 block (ids in a block, a multiple of 8), uint64 n_docs, n_ids, n_blocks; then (n_blocks + 1) uint64 byte offsets of the
blocks from the start of the payload; n_docs of (int64 doc_id, uint64 start in the shard, uint8 1 if doc_id is null); then the
payload, in which id k of a block takes bits [k * width, (k + 1) * width), lowest bit first. Blocks begin on byte boundaries, so any
range of ids is read by one seek to its first block, and a block unpacks in numpy without a loop.

Documents are dealt into ranges of doc_id; every task writes one shard under a name of its own attempt and reports it to the manifest,
one row per shard, which the driver holds. A lost or repeated attempt leaves a file that the manifest doesn't name. Starts over all
shards are a running sum over it.

Defined cases: a null or empty text has the end id only; rows with equal doc_id are all written, ordered by a hash of their text;
null doc_ids come first; ids that aren't whole
numbers count as null; an empty table gives no shard and no rows; columns of other names are ignored. The shared folder must be
one that pyarrow's file systems open (a mounted path, hdfs, s3, gs).
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redactory.llm.arrow import map_arrow, prepare, texts_of
from redactory.llm.token_count import PATTERN, byte_symbols
from redactory.session import scratch_path

MAGIC = b"TOKBITS1"
HEAD = np.dtype([("magic", "S8"), ("width", "<u4"), ("block", "<u4"), ("n_docs", "<u8"), ("n_ids", "<u8"), ("n_blocks", "<u8")])
ENTRY = np.dtype([("doc_id", "<i8"), ("start", "<u8"), ("null", "u1")])
BLOCK_IDS = 4096
#: Entries of a worker's tables of encoded stretches and pre-tokens, about 200 bytes each; a full table is emptied.
STRETCH_ENTRIES, PIECE_ENTRIES = 900_000, 120_000


#: White space other than a space or line feed, and NUL, which marks a text's first word below.
ODD_SPACE = re.compile("[\0\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def id_width(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """ids (uint32) in width bits each, lowest bit first, up to a whole byte."""
    ids = np.ascontiguousarray(ids, "<u4")
    if width % 8 == 0:
        return ids.view("u1").reshape(-1, 4)[:, : width // 8].tobytes()
    bits = np.unpackbits(ids.view("u1").reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    """The first n ids (uint32) of a packed block."""
    if width % 8 == 0:
        out = np.zeros((n, 4), "u1")
        out[:, : width // 8] = np.frombuffer(data, "u1", n * (width // 8)).reshape(n, -1)
        return out.view("<u4").ravel()
    bits = np.unpackbits(np.frombuffer(data, "u1"), count=n * width, bitorder="little").reshape(n, width)
    return np.packbits(np.pad(bits, ((0, 0), (0, 32 - width))), axis=1, bitorder="little").view("<u4").ravel()


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    if urlsplit(uri).scheme in ("", "file"):
        return pafs.LocalFileSystem(), urlsplit(uri).path
    return pafs.FileSystem.from_uri(uri)


class Shard:
    """Writer of one shard. Payload is held packed: width bits for each id of the shard."""

    def __init__(self, width: int, block: int = BLOCK_IDS):
        if block % 8:
            raise ValueError("block must be a multiple of 8")
        self.width, self.block, self.n_ids = width, block, 0
        self.index: list[tuple[int, int, int]] = []
        self.blocks: list[bytes] = []
        self.waiting, self.n_waiting = [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.index.append((doc_id or 0, self.n_ids, doc_id is None))
        self.n_ids += len(ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= 256 * self.block:
            self._flush(False)

    def _flush(self, all_of_it: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, "<u4")
        most = len(ids) if all_of_it else len(ids) // self.block * self.block
        self.blocks += [pack(ids[i : min(i + self.block, most)], self.width) for i in range(0, most, self.block)]
        self.waiting, self.n_waiting = [ids[most:]], len(ids) - most

    def save(self, fs: pafs.FileSystem, path: str) -> None:
        self._flush(True)
        head = np.array([(MAGIC, self.width, self.block, len(self.index), self.n_ids, len(self.blocks))], HEAD)
        with fs.open_output_stream(path) as f:
            f.write(head.tobytes())
            f.write(np.cumsum([0, *map(len, self.blocks)]).astype("<u8").tobytes())
            f.write(np.array(self.index, ENTRY).tobytes())
            for b in self.blocks:
                f.write(b)


class ShardReader:
    """Random access to the ids of a shard."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.file = fs.open_input_file(path)
        head = np.frombuffer(self.file.read(HEAD.itemsize), HEAD)[0]
        if head["magic"] != MAGIC:
            raise ValueError(f"{path} is no token file")
        self.width, self.block, self.n_ids, n = int(head["width"]), int(head["block"]), int(head["n_ids"]), int(head["n_blocks"])
        self.offsets = np.frombuffer(self.file.read(8 * (n + 1)), "<u8").astype(np.int64)
        self.docs = np.frombuffer(self.file.read(ENTRY.itemsize * int(head["n_docs"])), ENTRY)
        self.ends = np.append(self.docs["start"][1:], self.n_ids).astype(np.int64) if len(self.docs) else np.zeros(0, np.int64)
        self.base = self.file.tell()

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids [start, end) of the shard."""
        if end <= start:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (end - 1) // self.block
        self.file.seek(self.base + int(self.offsets[first]))
        data = self.file.read(int(self.offsets[last + 1] - self.offsets[first]))
        n = min((last + 1) * self.block, self.n_ids) - first * self.block
        return unpack(data, n, self.width)[start - first * self.block : end - first * self.block]

    def documents(self, span: int = 1 << 20) -> Iterator[tuple[int | None, int, int, int]]:
        """(doc_id, start in the shard, number of ids, crc32 of the ids as uint32), reading about span ids at once."""
        at, low, held = 0, 0, np.zeros(0, "<u4")
        for entry, end in zip(self.docs, self.ends, strict=True):
            start, crc = int(entry["start"]), 0
            at = start
            while at < end:
                if not low <= at < low + len(held):
                    low, held = at, self.ids(at, min(at + span, self.n_ids))
                part = held[at - low : end - low]
                crc = zlib.crc32(part.tobytes(), crc)
                at += len(part)
            yield (None if entry["null"] else int(entry["doc_id"])), start, int(end) - start, crc


class Stretches(dict):
    """Ids (packed uint32) by stretch: a word after a space, or after a mark: line feed, or NUL for none.

    The library's model gets one pre-token at a time: its own way through a text also makes offsets and strings for each token.
    """

    def __init__(self, library, special: list[str], feed: int):
        self.library, self.model, self.special, self.feed = library, library.model.tokenize, special, array("I", [feed]).tobytes()
        self.find = regex.compile(PATTERN).findall
        self.symbols = dict(enumerate(byte_symbols()))
        self.space, self.stops = self.symbols[32], frozenset(".,")
        self.pieces: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        if key.isalpha():
            ids = self.piece(" " + key)
        elif key[-1:] in self.stops and key[:-1].isalpha():  # letters, then one stop: two pre-tokens
            ids = self.piece(" " + key[:-1]) + self.piece(key[-1])
        else:
            mark = key[:1]
            text, ids = (key[1:], self.feed if mark == "\n" else b"") if mark == "\n" or mark == "\0" else (" " + key, b"")
            if any(h in text for h in self.special):
                ids += array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
            else:
                ids += b"".join(map(self.piece, self.find(text)))
        if len(key) <= 64:
            if len(self) >= STRETCH_ENTRIES:
                self.clear()
            self[key] = ids
        return ids

    def piece(self, piece: str) -> bytes:
        """Ids of one pre-token."""
        if (own := self.pieces.get(piece)) is None:
            if len(self.pieces) >= PIECE_ENTRIES:
                self.pieces.clear()
            symbols = piece.replace(" ", self.space) if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.symbols)
            own = array("I", [t.id for t in self.model(symbols)]).tobytes()
            if len(piece) <= 64:
                self.pieces[piece] = own
        return own


class Encoder:
    """Ids of whole texts by the tokenizers library. Stretches between white space are encoded once and kept as packed uint32."""

    _made: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        #: Cutting at single spaces and line feeds is exact for this pre-tokenizer only.
        cuts = spec["model"]["type"] == "BPE" and spec["pre_tokenizer"] is not None and spec["pre_tokenizer"]["type"] == "ByteLevel" and not spec["pre_tokenizer"].get("add_prefix_space") and not spec.get("normalizer")
        self.library = Tokenizer.from_file(path)
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        special = [t["content"] for t in spec["added_tokens"]]
        self.stretches = Stretches(self.library, special, self.library.token_to_id("Ċ")) if cuts else None

    def library_ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        get, out = self.stretches.__getitem__ if self.stretches is not None else None, []
        for t in texts:
            if get is None or not t or t[0] in " \n" or t[-1] in " \n" or "  " in t or "\n\n" in t or " \n" in t or "\n " in t or ODD_SPACE.search(t):
                ids = self.library_ids([t])[0]
            else:
                ids = b"".join(map(get, ("\0" + t.replace("\n", " \n")).split(" ")))
            out.append(np.frombuffer(ids, "<u4"))
        return out


def id_counts(spark: SparkSession, text: Column, tokenizer: str) -> Column:
    """Number of ids of each text, without an end id; null is empty."""
    prepare(spark)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder.of(tokenizer)
        for b in batches:
            yield pa.array([len(encoder.encode([t or ""])[0]) for t in b.to_pylist()], pa.int64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "long")(text)


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 0, block: int = BLOCK_IDS) -> list[tuple[int, str, int, int]]:
    """Writes shards in ascending order of id_col into folder (a new one). Returns the manifest: (shard, path, n_docs, n_ids) of each.

    One shuffle of (id, text) by ranges of id. end_id, if not None, follows each document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        encoder = Encoder.of(tokenizer)
        shard = Shard(id_width(encoder.size), block)
        end = np.zeros(0, "<u4") if end_id is None else np.array([end_id], "<u4")
        for b in batches:
            ids, texts = b.column(0).to_pylist(), list(texts_of(b.column(1)))
            for i in range(0, len(texts), 64):
                for doc_id, own in zip(ids[i : i + 64], encoder.encode(texts[i : i + 64]), strict=True):
                    shard.add(doc_id, np.concatenate((own, end)))
        if not shard.index:
            return
        fs, base = open_folder(folder)
        fs.create_dir(base, recursive=True)
        number = TaskContext.get().partitionId()
        name = f"shard-{number:06d}-{uuid.uuid4().hex}.tok"
        shard.save(fs, f"{base}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([name]), pa.array([len(shard.index)], pa.int64()), pa.array([shard.n_ids], pa.int64())], names=["shard", "path", "n_docs", "n_ids"])

    ranged = docs.select(F.col(id_col).try_cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tie = F.xxhash64("text")
    ranged = ranged.repartitionByRange(F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    return [tuple(r) for r in map_arrow(ranged, run, "shard long, path string, n_docs long, n_ids long").collect()]


def read_token_files(spark: SparkSession, manifest: list[tuple[int, str, int, int]], folder: str) -> DataFrame:
    """doc_id, start (over all shards), n_tokens, ids_crc32 of every document, from the files that a manifest names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_folder(folder)
        for b in batches:
            for name, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = [(d, first + s, n, c) for d, s, n, c in ShardReader(fs, f"{base}/{name}").documents()]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    first, placed = 0, []
    for _, name, _, n_ids in sorted(manifest):
        placed.append((name, first))
        first += n_ids
    return map_arrow(spark.createDataFrame(placed, "path string, first long"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(spark: SparkSession, docs: DataFrame, tokenizer: str, folder: str | None = None, **options) -> DataFrame:
    """Writes the token files of docs, then reads them back; see write_token_files and read_token_files."""
    folder = folder or scratch_path(spark, "token-files")
    return read_token_files(spark, write_token_files(docs, tokenizer, folder, **options), folder)
