"""What turns texts into vectors, chosen by the settings. ``semantic`` says whether
closeness means likeness of sense, so that a search may add candidates by it."""

from __future__ import annotations

import os
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.config import Config
from siftwell.sources import remote

from . import vectors as V


@dataclass(frozen=True)
class HashEmbedder:
    """Signed feature hashing: likeness of words, not of sense."""

    dimensions: int
    provider: str = "signed-feature-hash"
    model: str = ""
    semantic = False

    def transform(self, texts: DataFrame) -> DataFrame:
        """(unit_id, vector) of texts (unit_id, text); a text without tokens is all zeros."""
        got = V.dense(V.sparse_vectors(texts, self.dimensions), self.dimensions)
        none = F.array_repeat(F.lit(0.0), self.dimensions)
        return texts.select("unit_id").join(got, "unit_id", "left").select("unit_id", F.coalesce("vector", none).alias("vector"))


@dataclass(frozen=True)
class RemoteEmbedder:
    """A model behind an endpoint."""

    endpoint: str
    model: str
    api_key: str
    dimensions: int
    batch: int = 64
    timeout: float = 60
    retries: int = 3
    provider: str = "openai-compatible"
    semantic = True

    def __post_init__(self):
        for name in ("endpoint", "model"):
            if not getattr(self, name):
                raise remote.ProviderError(f"embedding.provider is {self.provider} but embedding.{name} is empty")
        remote.checked_endpoint(self.endpoint, self.api_key)

    def transform(self, texts: DataFrame) -> DataFrame:
        return remote.transform(texts, self.endpoint, self.model, self.api_key, self.dimensions, self.batch, self.timeout, self.retries)


@dataclass(frozen=True)
class LocalModelEmbedder:
    """A trained model that each Python worker loads once."""

    model: str
    dimensions: int
    batch: int = 64
    provider: str = "sentence-transformers"
    semantic = True

    def __post_init__(self):
        import importlib.util

        if not self.model:
            raise remote.ProviderError(f"embedding.provider is {self.provider} but embedding.model is empty")
        if importlib.util.find_spec("sentence_transformers") is None:
            raise remote.ProviderError(f"embedding.provider is {self.provider}, but that package is not installed here; install it, or set the provider to {HashEmbedder.provider}")

    def transform(self, texts: DataFrame) -> DataFrame:
        name, width, batch = self.model, self.dimensions, self.batch

        def run(parts):
            from sentence_transformers import SentenceTransformer

            model = SentenceTransformer(name)
            for pdf in parts:
                for at in range(0, len(pdf), batch):
                    p = pdf.iloc[at : at + batch]
                    got = model.encode(p["text"].tolist(), normalize_embeddings=True)
                    if got.shape[1] != width:
                        raise remote.ProviderError(f"{name} gives {got.shape[1]} numbers a vector, embedding.dimensions is {width}")
                    yield pd.DataFrame({"unit_id": p["unit_id"].tolist(), "vector": [[float(x) for x in v] for v in got]})

        return texts.select("unit_id", "text").mapInPandas(run, "unit_id string, vector array<double>")


def embedder(cfg: Config):
    """The embedder that the settings ask for. They name the variable that holds a key,
    never the key."""
    provider, width = cfg["embedding.provider"], cfg["embedding.dimensions"]
    if provider == "sentence-transformers":
        return LocalModelEmbedder(cfg["embedding.model"], width, cfg["embedding.batch"])
    if provider == "openai-compatible":
        name = cfg["embedding.api_key_env"]
        key = os.environ.get(name, "") if name else ""
        return RemoteEmbedder(cfg["embedding.endpoint"], cfg["embedding.model"], key, width, cfg["embedding.batch"], cfg["embedding.timeout"], cfg["embedding.retries"])
    return HashEmbedder(width)


def described(e) -> dict:
    """What an index says of its vectors."""
    return {"provider": e.provider, "model": e.model, "dimensions": e.dimensions, "semantic": e.semantic}
