"""Embedders: a registry, and a deterministic one that needs no network."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

Embedder = Callable[[list[str]], np.ndarray]
_REGISTRY: dict[str, Callable[..., Embedder]] = {}


def register(name: str, factory: Callable[..., Embedder]) -> None:
    _REGISTRY[name] = factory


def embedder(name: str, **options) -> Embedder:  # noqa: ANN003
    if name not in _REGISTRY:
        raise ValueError(f"unknown embedder {name}; known: {', '.join(sorted(_REGISTRY))}")
    return _REGISTRY[name](**options)


def embed(rows: DataFrame, name: str, text_col: str = "content", batch: int = 32, **options) -> DataFrame:  # noqa: ANN003
    """Adds ``embedding`` by a registered embedder, in batches; a count that differs is an error."""
    make = _REGISTRY[name] if name in _REGISTRY else embedder(name)

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make(**options)
        for s in parts:
            out = []
            for at in range(0, len(s), batch):
                texts = s.iloc[at : at + batch].fillna("").tolist()
                got = encode(texts)
                if len(got) != len(texts):
                    raise ValueError(f"{len(got)} vectors for {len(texts)} texts")
                out += [np.asarray(v, np.float32).tolist() for v in got]
            yield pd.Series(out)

    return rows.withColumn("embedding", run(F.col(text_col)))


def hash_embedding(docs: DataFrame, id_col: str, text_col: str, dim: int = 64) -> DataFrame:
    """(id, embedding array<double>): token hashes folded into ``dim`` places with signs, unit length; texts without a token have none."""
    from ..operators.sparse import counted

    counts = counted(docs, id_col, text_col).where("n_tokens > 0").select(id_col, "posts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.repeat(np.arange(b.num_rows), np.diff(b.column(1).offsets.to_numpy()))
            hashes, tf = (x.to_numpy() for x in b.column(1).flatten().flatten())
            sign = np.where(hashes // dim % 2 == 0, 1, -1)
            m = np.bincount(at * dim + hashes % dim, weights=sign * tf, minlength=b.num_rows * dim).reshape(-1, dim)
            m /= np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-300)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * dim, pa.int32()), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), vectors], [id_col, "embedding"])

    return counts.mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, embedding array<double>")


def _hashing(dim: int = 64) -> Embedder:
    """The same idea in numpy, on white-space words."""
    import zlib

    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                if w not in T.STOP_WORDS:
                    h = zlib.crc32(w.encode())
                    out[i, h % dim] += 1 if h >> 16 & 1 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return run


register("hashing", _hashing)


@dataclass(frozen=True)
class Service:
    """How an embedding service is asked: its path, the field that holds the texts, fixed fields, and texts a call."""

    path: str
    texts: str = "input"
    fixed: tuple[tuple[str, str], ...] = ()
    most: int = 256
    dim_field: str | None = None  # the field that asks for a dimension


#: Paths, fields and limits of the public services' interfaces.
SERVICES = {
    "llama": Service("/v1/embeddings"),
    "openai": Service("/v1/embeddings", dim_field="dimensions"),
    "openrouter": Service("/v1/embeddings", dim_field="dimensions"),
    "ollama": Service("/v1/embeddings", dim_field="dimensions"),
    "cohere": Service("/v1/embed", "texts", (("input_type", "search_document"),), 96),
    "voyage": Service("/v1/embeddings", "input", (("input_type", "document"),), 128),
}


def _over_http(service: Service, endpoint: str, model: str, api_key: str = "", dim: int = 0, timeout: float = 60, tries: int = 3, wait: float = 0.5) -> Embedder:
    """An embedder that asks a service; calls that fail for a passing reason (429, 5xx, no connection) are tried again."""
    import json
    import time
    import urllib.error
    import urllib.request

    def ask(texts: list[str]) -> dict:
        body = {"model": model, service.texts: texts, **dict(service.fixed)}
        if dim and service.dim_field:
            body[service.dim_field] = dim
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {api_key}"} if api_key else {})
        for left in range(tries - 1, -1, -1):
            try:
                request = urllib.request.Request(endpoint.rstrip("/") + service.path, json.dumps(body).encode(), headers)
                with urllib.request.urlopen(request, timeout=timeout) as answer:
                    return json.load(answer)
            except urllib.error.HTTPError as e:
                if not left or (e.code != 429 and e.code < 500):
                    raise RuntimeError(f"embedding service answered {e.code}: {e.read(200).decode(errors='replace')}") from None
            except urllib.error.URLError:
                if not left:
                    raise
            time.sleep(wait * 2 ** (tries - 1 - left))
        raise AssertionError

    def run(texts: list[str]) -> np.ndarray:
        out: list[list[float]] = []
        for at in range(0, len(texts), service.most):
            some = texts[at : at + service.most]
            answer = ask(some)
            rows = answer["embeddings"] if "embeddings" in answer else [d["embedding"] for d in sorted(answer["data"], key=lambda d: d.get("index", 0))]
            if len(rows) != len(some):
                raise ValueError(f"{len(rows)} vectors for {len(some)} texts")
            if dim and rows and len(rows[0]) != dim:
                raise ValueError(f"vectors of length {len(rows[0])}, not {dim}")
            out += rows
        return np.array(out, np.float32)

    return run


for _name, _service in SERVICES.items():
    register(_name, partial(_over_http, _service))


def discovered(names: list[str]) -> list[str]:
    """Of a service's model names those that seem to be embedding models, once each, in order."""
    return list(dict.fromkeys(n for n in names if any(x in n.lower() for x in ("embed", "voyage", "bge"))))
