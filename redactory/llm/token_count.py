"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut where the byte-level pre-tokenizer cuts it. Each piece starts as one symbol per UTF-8 byte, linked to its
neighbours; a heap yields the adjacent pair of lowest rank (leftmost among equals), which is merged until no ranked pair is left.
The count of a piece is its initial symbols minus its merges; no identifiers are made. Counts of pieces are kept in bounded
tables that live as long as the Python worker, so a frequent word is merged once.

Defined cases: a null or empty text has 0 bytes and 0 tokens; the strings of special tokens inside a text count as one token each,
as the tokenizers library has it by default; lone surrogates cannot occur in Parquet strings; rows with equal ids are counted
separately; columns of other names are ignored.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactory.llm.arrow import map_arrow, texts_of

#: Cuts of byte-level pre-tokenization (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of a worker's table of counts, about 150 bytes each. A full table is emptied: entries are made again when needed.
CACHE_ENTRIES = 600_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    known = set(plain)
    return [chr(b) if b in known else chr(next(rest)) for b in range(256)]


class Merger:
    """Ranks of merges over byte strings, and the count of symbols that are left of a piece."""

    def __init__(self, ranks: dict[tuple[bytes, bytes], int]):
        self.ranks = ranks

    def count(self, piece: bytes) -> int:
        n = len(piece)
        if n < 2:
            return n
        ranks = self.ranks
        symbol: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get((symbol[i], symbol[i + 1]))) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, size = heapq.heappop(heap)
            # an entry is stale if its left symbol is gone or either side has grown since
            if (a := symbol[i]) is None or (j := after[i]) >= n or len(a) + len(symbol[j]) != size:
                continue
            symbol[i], symbol[j] = (a := a + symbol[j]), None
            after[i] = k = after[j]
            left -= 1
            if k < n:
                before[k] = i
                if (r := ranks.get((a, symbol[k]))) is not None:
                    heapq.heappush(heap, (r, i, size + len(symbol[k])))
            if (h := before[i]) >= 0 and (r := ranks.get((symbol[h], a))) is not None:
                heapq.heappush(heap, (r, h, len(symbol[h]) + size))
        return left


class Pieces(dict):
    """Count of tokens by the text of a pre-token."""

    def __init__(self, merger: Merger):
        self.merger = merger

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[piece] = n = self.merger.count(piece.encode())
        return n


class Chunks(dict):
    """Count of tokens by a stretch between white space, with or without the space before it."""

    def __init__(self, pieces: Pieces, space: str):
        self.pieces, self.space, self.find = pieces, space, regex.compile(PATTERN).findall

    def __missing__(self, chunk: str) -> int:
        n = sum(map(self.pieces.__getitem__, self.find(self.space + chunk)))
        if len(chunk) <= 64:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[chunk] = n
        return n


def single_spaced(text: str) -> bool:
    """Whether all white space of a text is single spaces and line feeds between words."""
    words, n = text.split(), text.count(" ") + text.count("\n")
    return len(words) == n + 1 and sum(map(len, words)) + n == len(text)


class TokenCounter:
    """Counts the tokens of texts under a byte-level BPE vocabulary file."""

    _made: dict[str, TokenCounter] = {}

    @classmethod
    def of(cls, path: str) -> TokenCounter:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError(f"{path} isn't a plain byte-level BPE vocabulary")
        back = {s: bytes([b]) for b, s in enumerate(byte_symbols())}
        raw = lambda s: b"".join(map(back.__getitem__, s))
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.merger = Merger({(raw(a), raw(b)): rank for rank, (a, b) in enumerate(pairs)})
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        self.hints = [t["content"] for t in spec["added_tokens"]]
        pieces = Pieces(self.merger)
        self.pieces, self.first, self.spaced = pieces, Chunks(pieces, ""), Chunks(pieces, " ")

    def count(self, text: str) -> int:
        if any(h in text for h in self.hints):
            return len(self.special.findall(text)) + sum(map(self._plain, self.special.split(text)))
        return self._plain(text)

    def _plain(self, text: str) -> int:
        if not text:
            return 0
        if single_spaced(text):  # every space starts a pre-token, every line feed is one
            first, spaced = self.first.__getitem__, self.spaced.__getitem__
            n = text.count("\n")
            for line in text.split("\n"):
                head, *rest = line.split(" ")
                n += first(head) + sum(map(spaced, rest))
            return n
        return sum(map(self.pieces.__getitem__, self.first.find(text)))


def count_tokens(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """One row per document: its id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit). No shuffle.

    tokenizer: path of a byte-level BPE vocabulary in the format of the tokenizers library, present on all machines.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter.of(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([counter.count(t) for t in texts_of(b.column(2))], pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    kind = docs.select(F.col(id_col)).dtypes[0][1]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    return map_arrow(rows, run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
