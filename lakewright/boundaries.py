"""What lies outside of the engine: fetching, rendering, models.

These are protocols only.  Nothing here pretends to have fetched a page or run a model;
queries take captured pages, given vectors and recorded replies as tables.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Protocol

from pyspark.sql import DataFrame, functions as F


class Encoder(Protocol):
    def encode(self, texts: Sequence[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    def scores(self, question: str, texts: Sequence[str]) -> list[float]: ...


class Completer(Protocol):
    def complete(self, messages: Sequence[dict], schema: dict | None = None) -> str: ...

    def stream(self, messages: Sequence[dict]) -> Iterator[str]: ...


class Fetcher(Protocol):
    def fetch(self, url: str) -> tuple[int, str, bytes]: ...


def embed_missing(rows: DataFrame, make_encoder, text: str = "body", vector: str = "embedding", batch: int = 64) -> DataFrame:
    """Vectors for rows that have none and whose text is not empty; make_encoder() runs once a task."""

    def run(frames):
        encoder = make_encoder()
        for pdf in frames:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch].copy()
                part[vector] = encoder.encode(part[text].tolist())
                yield part

    todo = rows.where(F.col(vector).isNull() & (F.coalesce(text, F.lit("")) != ""))
    return todo.mapInPandas(run, todo.schema)


def fetch_by_host(targets: DataFrame, make_fetcher, url: str = "url", host: str = "host", partitions: int = 64) -> DataFrame:
    """(url, status, content_type, body): each host's urls one after another in one task."""

    def run(frames):
        fetcher = make_fetcher()
        for pdf in frames:
            got = [fetcher.fetch(u) for u in pdf[url]]
            yield pdf[[url]].assign(status=[g[0] for g in got], content_type=[g[1] for g in got], body=[g[2] for g in got])

    return targets.select(url, host).repartition(partitions, host).mapInPandas(run, f"{url} string, status int, content_type string, body binary")
