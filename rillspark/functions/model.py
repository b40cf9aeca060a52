"""Model functions: embeddings, structured extraction and images, each with a client that is passed in.

A client is any object with the method that the function calls; factories run once per worker. Providers are looked up
by name: clients that were registered, else those of `providers`.
"""

from __future__ import annotations

import hashlib
import importlib
import inspect
import json
import math
from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillspark.functions.providers import Client
from rillspark.types import resolve, wrapped_schema, with_facts


class EmbeddingClient(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class GenerationClient(Protocol):
    def generate(self, prompt: str, schema: dict, image: bytes | None = None) -> str: ...


#: Providers with a client over HTTP, and whether they (generate, embed).
PROVIDERS = {
    "Ollama": (True, True), "OpenAi": (True, True), "Gemini": (True, True), "Anthropic": (True, False), "LiteLlm": (True, False), "OpenRouter": (True, True),
    "Voyage": (False, True), "Vllm": (True, False), "VertexAi": (True, True), "Bedrock": (True, False), "AzureOpenAi": (True, True),
}
_clients: dict[str, Callable[..., Any]] = {}


def register_client(api_type: str, factory: Callable[..., Any]) -> None:
    _clients[api_type] = factory


def client_factory(api_type: str, kind: str) -> Callable[..., Any]:
    if api_type in _clients:
        return _clients[api_type]
    if api_type not in PROVIDERS:
        raise ValueError(f"unknown provider {api_type!r}")
    if not PROVIDERS[api_type][kind == "embedding"]:
        raise ValueError(f"{api_type} has no {kind}")
    return partial(Client, api_type)


class HashEmbedder:
    """An embedding without a model: words hashed to signed dimensions, scaled to length 1. Deterministic."""

    def __init__(self, model: str = "hash", dimension: int = 64):
        self.model, self.dimension = model, dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dimension
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8, key=self.model.encode()[:64]).digest(), "little")
                v[h % self.dimension] += 1.0 if h >> 63 else -1.0
            norm = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / norm for x in v])
        return out


register_client("Hash", HashEmbedder)


@lru_cache(maxsize=8)
def cached_client(make: Callable[..., Any], options: tuple) -> Any:
    return make(**dict(options))


def embed_text(text: Column, api_type: str = "Hash", model: str = "hash", dimension: int | None = None, batch_size: int = 64, factory: Callable[..., Any] | None = None, **more: Any) -> Column:
    """array<float> of each text, `batch_size` texts a call, shortest first; null for null. A vector of another length
    than `dimension` fails. more: what the provider's client needs, such as address and api_key."""
    make = factory or client_factory(api_type, "embedding")
    options = (("model", model), *((("dimension", dimension),) if dimension else ()), *sorted(more.items()))

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = cached_client(make, options)
        for s in batches:
            live = sorted((i for i, t in enumerate(s) if t is not None), key=lambda i: len(s.iloc[i]))
            out: list = [None] * len(s)
            for at in range(0, len(live), batch_size):
                part = live[at : at + batch_size]
                for i, v in zip(part, client.embed([s.iloc[i] for i in part])):
                    if dimension and len(v) != dimension:
                        raise ValueError(f"{model} gave {len(v)} dimensions, not {dimension}")
                    out[i] = v
            yield pd.Series(out, dtype=object)

    if dimension is None:  # the client's own, if it has one whatever the model
        dimension = getattr(inspect.signature(make).parameters.get("dimension"), "default", None)
    return with_facts(embed.asNondeterministic()(text), logical="Vector", dim=dimension if isinstance(dimension, int) else None)


class SentenceTransformer:
    """A model of the sentence-transformers library, loaded once per worker; its dimension is the model's own."""

    def __init__(self, model: str, dimension: int | None = None, **arguments: Any):
        library = importlib.import_module("sentence_transformers")
        self.loaded = library.SentenceTransformer(model, **arguments)
        self.dimension = self.loaded.get_sentence_embedding_dimension()

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[float(x) for x in v] for v in self.loaded.encode(texts, convert_to_numpy=True)]


def sentence_transformer_embed(text: Column, model: str, batch_size: int = 512, **arguments: Any) -> Column:
    """array<float> of each text by a sentence-transformers model; null for null."""
    return embed_text(text, model=model, batch_size=batch_size, factory=SentenceTransformer, **arguments)


def embed_queries(text: Column, factory: Callable[..., Any], model: str = "", dimension: int | None = None) -> Column:
    """array<array<float>>, one vector (of `dimension`, if given) per token, of each query text, to be held against images' by
    MaxSim."""

    @F.pandas_udf("array<array<float>>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = cached_client(factory, (("model", model),))
        for s in batches:
            yield s.map(client.embed_query, na_action="ignore")

    return with_facts(embed.asNondeterministic()(text), logical="Vector" if dimension else None, dim=dimension)


def embed_images(image: Column, factory: Callable[..., Any], model: str = "", dimension: int | None = None) -> Column:
    """array<array<float>>, one vector (of `dimension`, if given) per patch, of each image."""

    @F.pandas_udf("array<array<float>>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = cached_client(factory, (("model", model),))
        for s in batches:
            yield s.map(lambda b: client.embed_image(bytes(b)), na_action="ignore")

    return with_facts(embed.asNondeterministic()(image), logical="Vector" if dimension else None, dim=dimension)


def extract(output_type: Any, factory: Callable[..., Any] | str, text: Column | None = None, image: Column | None = None, instruction: str = "", model: str = "", **more: Any) -> Column:
    """A typed value of what a model says under the type's JSON schema; null if text and image are both null. factory: of a
    client, or a provider's name, whose client takes `more`."""
    make = client_factory(factory, "generation") if isinstance(factory, str) else factory
    kind = resolve(output_type)
    schema, wrapped = wrapped_schema(kind.data_type, kind.metadata)

    @F.pandas_udf("string")
    def generate(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        client = cached_client(make, (("model", model), *sorted(more.items())))
        for texts, images in batches:
            out = []
            for t, b in zip(texts, images):
                if t is None and b is None:
                    out.append(None)
                    continue
                said = client.generate(f"{instruction}\n\n{t or ''}".strip(), schema, None if b is None else bytes(b))
                json.loads(said)  # what isn't JSON fails here rather than turns null below
                out.append(said)
            yield pd.Series(out, dtype=object)

    said = generate.asNondeterministic()(text if text is not None else F.lit(None).cast("string"), image if image is not None else F.lit(None).cast("binary"))
    if wrapped:
        return F.from_json(said, T.StructType([T.StructField("value", kind.data_type)]), {"mode": "FAILFAST"})["value"]
    return F.from_json(said, kind.data_type, {"mode": "FAILFAST"})
