"""Embedding backends: none, a local model, or an external service that has to be allowed three times over."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from typing import Protocol, runtime_checkable
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from rootweave.config import Config

KEY_VARIABLE = "ROOTWEAVE_EMBEDDING_KEY"
#: Texts of one call to a backend.
CALL_TEXTS = 64
#: (endpoint, key, model, texts) to one vector a text.
Transport = Callable[[str, str, str, list[str]], list[list[float]]]


class EmbeddingError(RuntimeError):
    """A backend that is refused, misconfigured or unusable."""


@runtime_checkable
class Backend(Protocol):
    """Workers call embed, so its class has to be in a module that they can import."""

    enabled: bool
    name: str
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Noop:
    enabled, name, dim = False, "noop", 0

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[] for _ in texts]


class Local:
    """A sentence-transformers model, loaded by each worker when it is first used."""

    enabled, dim = True, 0

    def __init__(self, model: str) -> None:
        self.name, self._model_name, self._model = f"local:{model}", model, None

    def embed(self, texts: list[str]) -> list[list[float]]:
        if self._model is None:
            try:
                from sentence_transformers import SentenceTransformer
            except ImportError as e:
                raise EmbeddingError("local embeddings need the sentence-transformers package") from e
            self._model = SentenceTransformer(self._model_name)
        found = self._model.encode(texts, normalize_embeddings=True)
        self.dim = len(found[0]) if len(found) else 0
        return [[float(x) for x in v] for v in found]


def post(endpoint: str, key: str, model: str, texts: list[str]) -> list[list[float]]:
    request = Request(endpoint, json.dumps({"input": texts, "model": model}).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
    with urlopen(request, timeout=30) as answer:
        return [x["embedding"] for x in json.load(answer)["data"]]


class External:
    enabled, dim = True, 0

    def __init__(self, endpoint: str, key: str, model: str, transport: Transport = post) -> None:
        self.name, self._call = f"external:{model}", (endpoint, key, model)
        self._transport = transport

    def embed(self, texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        found = self._transport(*self._call, list(texts))
        if not found or not found[0]:
            raise EmbeddingError("the embedding service gave no vectors")
        self.dim = len(found[0])
        return [[float(x) for x in v] for v in found]


def backend_of(config: Config, warn: Callable[[str], None] = lambda _: None, transport: Transport = post) -> Backend:
    """The configured backend. An external one needs the flag, a key in the environment and an endpoint, and is announced."""
    e = config.embeddings
    if not e.enabled or e.backend == "noop":
        return Noop()
    if e.backend == "local":
        return Local(e.model)
    if e.backend != "external":
        raise EmbeddingError(f"unknown backend {e.backend}")
    key = os.environ.get(KEY_VARIABLE)
    for missing, what in ((not e.allow_external, "allow_external"), (not key, f"a key in {KEY_VARIABLE}"), (not e.endpoint, "an endpoint")):
        if missing:
            raise EmbeddingError(f"external embeddings need {what}")
    warn(f"texts are sent to {e.endpoint} for embedding")
    return External(e.endpoint, key, e.model, transport)


def embedded(backend: Backend, text: Column) -> Column:
    """The vectors of a column of texts: a worker calls its backend with CALL_TEXTS at once."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        values, out = texts.fillna("").tolist(), []
        for lo in range(0, len(values), CALL_TEXTS):
            out += backend.embed(values[lo : lo + CALL_TEXTS])
        return pd.Series(out)

    return run(text)
