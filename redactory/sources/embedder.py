"""Vectors from an embedding service over HTTP. Off unless it is asked for; texts leave the cluster."""

from __future__ import annotations

import base64
import json
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    def vectors(self, texts: list[str]) -> list[list[float]]: ...


def vectors_at(body: object, path: str) -> list[list[float]] | None:
    """The vectors at a path of keys; a key that ends in [] goes through the items of an array. None unless they are lists of numbers."""
    rows, many = [body], False
    keys = [k for k in path.split(".") if k]
    if not keys:
        return None
    for key in keys:
        hop = key.endswith("[]") and not many
        name = key[:-2] if hop else key
        rows = [r.get(name) if isinstance(r, dict) else None for r in rows]
        if hop:
            if not isinstance(rows[0], list):
                return None
            rows, many = rows[0], True
    if not many:
        rows = rows[0]
    good = isinstance(rows, list) and rows and all(isinstance(r, list) and all(isinstance(x, int | float) and not isinstance(x, bool) for x in r) for r in rows)
    return rows if good else None


@dataclass(frozen=True)
class HttpEmbedder:
    """format: native ({texts}, embeddings), rows ({input, model}, data rows in the order of their index) or custom (own names)."""

    url: str
    format: str = "native"
    model: str = ""
    auth: str = "none"
    token: str = field(default="", repr=False)
    key_header: str = "x-api-key"
    path: str = ""
    request_field: str = "texts"
    response_path: str = "embeddings"
    timeout_s: float = 3.0

    def headers(self) -> dict[str, str]:
        basic = lambda: "Basic " + base64.b64encode(self.token.encode()).decode()
        own = {"bearer": lambda: {"Authorization": f"Bearer {self.token}"}, "apiKey": lambda: {self.key_header: self.token}, "basic": lambda: {"Authorization": basic()}}
        return {"Content-Type": "application/json"} | (own[self.auth]() if self.auth in own and self.token else {})

    def body(self, texts: list[str]) -> dict:
        if self.format == "rows":
            return {"input": texts, "model": self.model or "text-embedding-3-small"}
        name = self.request_field.strip() or "texts" if self.format == "custom" else "texts"
        return {name: texts} | ({"model": self.model} if self.model else {})

    def read(self, body: object) -> list[list[float]] | None:
        if self.format == "rows":
            rows = body.get("data") if isinstance(body, dict) else None
            if not isinstance(rows, list):
                return None
            found = [r.get("embedding") for r in sorted(rows, key=lambda r: r.get("index") or 0)]
            return found if all(isinstance(v, list) for v in found) else None
        return vectors_at(body, (self.response_path.strip() or "embeddings") if self.format == "custom" else "embeddings")

    def address(self) -> str:
        own = self.path.strip().rstrip("/")
        return self.url.rstrip("/") + ((own if own.startswith("/") else f"/{own}") if own else "/embeddings" if self.format == "rows" else "/embed-batch")

    def vectors(self, texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        request = urllib.request.Request(self.address(), json.dumps(self.body(texts)).encode(), self.headers(), method="POST")
        try:
            with urllib.request.urlopen(request, timeout=self.timeout_s) as r:
                found = self.read(json.load(r))
        except urllib.error.HTTPError as e:
            refused = " (check the kind of authorization and its token)" if e.code in (401, 403) else ""
            raise RuntimeError(f"{self.url} answered HTTP {e.code}{refused}") from e
        if found is None or len(found) != len(texts):
            raise RuntimeError(f"{self.address()} answered in an unexpected form for format {self.format}")
        return found


def with_vectors(df: DataFrame, embedder: Embedder, text_col: str = "text", vector_col: str = "vector", batch: int = 64) -> DataFrame:
    """df with a vector for each text, or null where the service fails: what depends on vectors is then open, not shut."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            texts, out = [t or "" for t in b.to_pylist()], []
            for i in range(0, len(texts), batch):
                own = texts[i : i + batch]
                try:
                    out += embedder.vectors(own)
                except (RuntimeError, OSError, ValueError):
                    out += [None] * len(own)
            yield pa.array(out, pa.list_(pa.float64()))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return df.withColumn(vector_col, F.arrow_udf(run, "array<double>")(F.col(text_col)))
