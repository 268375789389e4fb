"""Calls to models: an embedder and a generator that can be replaced, fallback chains, and the cost of calls."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.session import ship_package

Embedder = Callable[[Sequence[str]], Sequence[Sequence[float] | None]]


def hashing_embedder(width: int = 64) -> Embedder:
    """A deterministic offline embedder: signed hashes of words, normalised; a text without words has none."""

    def embed(texts: Sequence[str]) -> list[list[float] | None]:
        out = []
        for text in texts:
            v = np.zeros(width)
            for w in text.lower().split():
                h = xxhash.xxh3_64_intdigest(w)
                v[h % width] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n).tolist() if n else None)
        return out

    return embed


def embed(rows: DataFrame, text: str, embedder: Embedder, batch: int = 32) -> DataFrame:
    """The rows with ``embedding array<float>``; NULL where there is no text or no vector, never out of step."""
    ship_package(rows.sparkSession)
    at, names = rows.columns.index(text), [*rows.columns, "embedding"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            vectors: list = [None] * len(texts)
            full = [i for i, t in enumerate(texts) if t]
            for a in range(0, len(full), batch):
                part = full[a : a + batch]
                for i, v in zip(part, embedder([texts[i] for i in part]), strict=True):
                    vectors[i] = None if v is None else list(v)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float32()))], names=names)

    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(run, f"{fields}, embedding array<float>")


def as_embedder(given: object) -> Embedder:
    """An embedder from what a caller has: a function of a list, one of a single text, or an object with ``embed_batch``
    or ``embed``."""
    batch, single = getattr(given, "embed_batch", None), getattr(given, "embed", None)
    if batch is not None:
        return batch
    call = single if single is not None else given

    def run(texts: Sequence[str]) -> Sequence[Sequence[float] | None]:
        try:
            out = call(list(texts))
        except (TypeError, AttributeError):  # takes one text at a time
            return [call(t) for t in texts]
        whole = out is not None and len(out) == len(texts) and all(v is None or hasattr(v, "__len__") for v in out)
        return out if whole else [call(t) for t in texts]

    return run


def tokens_of(lines: Iterator[str]) -> Iterator[str]:
    """The tokens of a streamed reply of one JSON object a line, up to the one that is ``done``; broken lines are passed over."""
    for line in lines:
        try:
            part = json.loads(line)
        except ValueError:
            continue
        if part.get("response"):
            yield part["response"]
        if part.get("done"):
            return


def named(models: DataFrame, name: str, words: tuple[str, ...] = ("embed", "bge", "minilm", "e5")) -> DataFrame:
    """The models whose name holds one of the words, in any letter case."""
    return models.where(F.lower(F.col(name)).rlike("|".join(words)))


def recommended(models: DataFrame, category: str, most_gb: float) -> DataFrame:
    """The models of a category that fit a size, the largest first."""
    return models.where((F.col("category") == category) & (F.col("size_gb") <= most_gb)).orderBy(F.desc("size_gb"), "name")


def conversation(messages: Column) -> Column:
    """One prompt of messages (role, content) in their order."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.initcap(m["role"]), F.lit(": "), m["content"])), "\n\n")


def generate(rows: DataFrame, prompt: str, providers: Sequence[Callable[[str], str | None]], retries: int = 2, wait: float = 0.0) -> DataFrame:
    """The rows with ``response`` and ``provider`` (its number): the first provider that answers, each tried a few times,
    with a pause of ``wait`` seconds that doubles after every failure."""
    ship_package(rows.sparkSession)
    at, names = rows.columns.index(prompt), [*rows.columns, "response", "provider"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said, by = [], []
            for text in b.column(at).to_pylist():
                answer, number = None, None
                for k, call in enumerate(providers):
                    for attempt in range(retries):
                        if attempt and wait:
                            time.sleep(wait * 2 ** (attempt - 1))
                        try:
                            answer = call(text or "")
                        except Exception:  # noqa: BLE001  a provider that fails is passed over
                            answer = None
                        if answer is not None:
                            break
                    if answer is not None:
                        number = k
                        break
                said.append(answer)
                by.append(number)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(said, pa.string()), pa.array(by, pa.int32())], names=names)

    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(run, f"{fields}, response string, provider int")


def cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """``cost`` of calls (model, tokens_in, tokens_out) by a table of prices for 1000 tokens; unknown models cost 0."""
    price = F.broadcast(prices.select("model", "price_in", "price_out"))  # a list of models
    joined = calls.join(price, "model", "left")
    return joined.withColumn("cost", F.round(F.coalesce(F.col("tokens_in") / 1000 * F.col("price_in") + F.col("tokens_out") / 1000 * F.col("price_out"), F.lit(0.0)), 9)).drop("price_in", "price_out")
