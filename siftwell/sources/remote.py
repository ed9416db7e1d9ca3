"""Vectors from a remote endpoint, in Arrow batches; off unless an endpoint is set."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

PERMANENT = frozenset({400, 401, 403, 404, 405, 422})


class ProviderError(RuntimeError):
    pass


def checked_endpoint(endpoint: str, api_key: str) -> None:
    """A key never goes in clear to another machine."""
    u = urllib.parse.urlparse(endpoint)
    if u.scheme not in ("http", "https") or not u.hostname:
        raise ProviderError("the endpoint must be an http or https URL")
    if api_key and u.scheme == "http" and u.hostname not in ("localhost", "127.0.0.1", "::1"):
        raise ProviderError("refusing to send a key over http")


def ordered(reply, n: int, dimensions: int) -> list[list[float]]:
    """The reply's vectors in the order of their index, validated column by column."""
    rows = reply.get("data") if isinstance(reply, dict) else None
    if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows):
        raise ProviderError("the reply holds no list of vectors")
    places, vectors = [r.get("index") for r in rows], [r.get("embedding") for r in rows]
    if any(type(i) is not int for i in places) or sorted(places) != list(range(n)):
        raise ProviderError(f"indexes 0 to {n - 1} were asked for, each once")
    try:
        table = np.array(vectors, dtype=np.float64).reshape(n, -1)
    except (TypeError, ValueError):
        raise ProviderError("vectors are not numbers, or of several widths") from None
    if table.shape != (n, dimensions) or not np.isfinite(table).all():
        raise ProviderError(f"vectors are not of {dimensions} finite numbers")
    return table[np.argsort(places)].tolist()


def _asked(request: urllib.request.Request, timeout: float) -> tuple[str, object]:
    """(what came of one attempt: ok, again or never; the reply, or a word for the failure).
    A reply that is no JSON would not be one the next time."""
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return "ok", json.load(r)
    except urllib.error.HTTPError as e:
        return "never" if e.code in PERMANENT else "again", f"status {e.code}"
    except ValueError:
        return "never", "the reply is no JSON"
    except (urllib.error.URLError, OSError) as e:
        return "again", type(e).__name__


def embed_batch(texts: list[str], endpoint: str, model: str, api_key: str, dimensions: int, timeout: float = 60, retries: int = 3) -> list[list[float]]:
    checked_endpoint(endpoint, api_key)
    head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {api_key}"} if api_key else {})
    request = urllib.request.Request(endpoint, json.dumps({"model": model, "input": texts}).encode(), head)
    # waits before each attempt
    for wait in (0, *(2**i for i in range(retries))):
        time.sleep(wait)
        how, got = _asked(request, timeout)
        if how == "ok":
            return ordered(got, len(texts), dimensions)
        if how == "never":
            break
    raise ProviderError(str(got))


def transform(texts: DataFrame, endpoint: str, model: str, api_key: str, dimensions: int, batch: int = 64, timeout: float = 60, retries: int = 3) -> DataFrame:
    """(unit_id, vector) of texts (unit_id, text)."""

    def run(parts):
        for pdf in parts:
            for at in range(0, len(pdf), batch):
                p = pdf.iloc[at : at + batch]
                yield pd.DataFrame({"unit_id": p["unit_id"].tolist(), "vector": embed_batch(p["text"].tolist(), endpoint, model, api_key, dimensions, timeout, retries)})

    return texts.select("unit_id", "text").mapInPandas(run, "unit_id string, vector array<double>")
