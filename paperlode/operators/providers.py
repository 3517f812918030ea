"""Slots for models: embed, rerank, complete and extract. No model comes with the library.

A slot takes a provider. A Stored one is a table of outputs made before, joined by a key; it is the default way, as it
scales and repeats itself. A Loaded one is a function that is loaded once in each Python worker and called with small
batches. Either way a row that gets no output keeps its place, with the reason, and what follows can fall back.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Stored:
    """outputs: key, output; of a key that repeats, the smallest output counts."""

    outputs: DataFrame


@dataclass
class Loaded:
    """load() gives a function from a list of inputs to as many outputs; name tells models apart within a worker."""

    name: str
    load: Callable[[], Callable[[list], list]]
    batch_rows: int = 32


Provider = Stored | Loaded

_MODELS: dict[str, Callable[[list], list]] = {}


def model_of(provider: Loaded) -> Callable[[list], list]:
    """The provider's function, loaded at its first use in this worker."""
    if provider.name not in _MODELS:
        _MODELS[provider.name] = provider.load()
    return _MODELS[provider.name]


def text_key(*texts: Column | str) -> Column:
    """The key of stored outputs: the SHA-256 of what goes into the model, put together by colons."""
    return F.sha2(F.concat_ws(":", *[F.coalesce(F.col(t) if isinstance(t, str) else t, F.lit("")) for t in texts]), 256)


def run(rows: DataFrame, key: Column, inputs: list[str], provider: Provider, kind: str) -> DataFrame:
    """rows with output (of type kind) and error: `missing` where a table has none, else the name of what was raised.

    A batch that a model refuses is tried row by row, so that one input does not cost the others their output.
    """
    if isinstance(provider, Stored):
        known = provider.outputs.groupBy("key").agg(F.min("output").alias("output"))
        out = rows.withColumn("__key", key).join(known.withColumnRenamed("key", "__key"), "__key", "left").drop("__key")
        return out.withColumn("error", F.when(F.col("output").isNull(), "missing"))

    def outputs(model, some: list) -> list[tuple[Any, str | None]]:
        try:
            made = model(some)
            if len(made) != len(some):
                raise ValueError("another number of outputs")
            return [(x, None) for x in made]
        except Exception as e:  # noqa: BLE001 - whatever a model raises is data here
            return [(None, type(e).__name__)] if len(some) == 1 else [y for x in some for y in outputs(model, [x])]

    def batches(frames):
        model = model_of(provider)
        for pdf in frames:
            for at in range(0, len(pdf), provider.batch_rows):
                part = pdf.iloc[at : at + provider.batch_rows]
                given = part[inputs[0]].tolist() if len(inputs) == 1 else list(zip(*[part[c].tolist() for c in inputs]))
                made = outputs(model, given)
                yield part.assign(output=[m[0] for m in made], error=[m[1] for m in made])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(batches, f"{fields}, output {kind}, error string")


def embed(texts: DataFrame, provider: Provider) -> DataFrame:
    """texts (with column text) with output: array<double>."""
    return run(texts, text_key("text"), ["text"], provider, "array<double>")


def complete(prompts: DataFrame, provider: Provider) -> DataFrame:
    """prompts (with column prompt) with output: the reply."""
    return run(prompts, text_key("prompt"), ["prompt"], provider, "string")


def extract(pages: DataFrame, provider: Provider) -> DataFrame:
    """pages (with columns content, page_number, prompt) with output: the raw reply, to be parsed by the caller."""
    key = text_key(F.sha2("content", 256), F.col("page_number").cast("string"), F.col("prompt"))
    return run(pages, key, ["content", "prompt"], provider, "string")


def rerank(pairs: DataFrame, provider: Provider, top_n: int = 5) -> DataFrame:
    """query_id, item_id, score, place, reranked: the top_n of each query by score, ties by rank.

    pairs: query_id, query, item_id, content, rank. A query none of whose pairs has a score keeps its order, with score
    0 and reranked false; pairs without a score among others that have one go last.
    """
    scored = run(pairs, text_key("query", "content"), ["query", "content"], provider, "double")
    of = Window.partitionBy("query_id")
    scored = scored.withColumn("reranked", F.count("output").over(of) > 0)
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("output"), "rank", "item_id")
    out = scored.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= top_n)
    return out.select("query_id", "item_id", F.when(F.col("reranked"), F.col("output")).otherwise(0.0).alias("score"), "place", "reranked")
