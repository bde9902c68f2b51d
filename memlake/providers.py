"""Embedding and completion providers: a small interface with deterministic offline versions."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Statuses under 500 that are worth another try; so is every one from 500 on.
RETRY_STATUSES = (408, 409, 425, 429)


def retryable_status(status: int) -> bool:
    return status in RETRY_STATUSES or 500 <= status <= 599


class ProviderError(Exception):
    """A call that failed; `retryable` if the same call may do better."""

    def __init__(self, message: str, retryable: bool):
        super().__init__(message)
        self.retryable = retryable


class Embedder(Protocol):
    model: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Completer(Protocol):
    def complete(self, system: str, prompt: str) -> str: ...


class HashEmbedder:
    """Unit vectors of hashed words: alike words, alike vectors. No network."""

    def __init__(self, size: int = 64):
        self.model, self.size = "hash-embedding", size

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(self.size)
            for w in (text or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % self.size] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).astype(float).tolist())
        return out


class CannedCompleter:
    """Answers by a function of (system, prompt), or with one fixed reply."""

    def __init__(self, reply: str | dict | Callable[[str, str], str]):
        self.reply = reply

    def complete(self, system: str, prompt: str) -> str:
        if callable(self.reply):
            return self.reply(system, prompt)
        return self.reply if isinstance(self.reply, str) else json.dumps(self.reply)


def embedded(text: Column, embedder: Embedder) -> Column:
    """Vectors of a text column, by Arrow batches; the client is made once a batch stream."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series(embedder.embed(s.fillna("").tolist()))

    return F.pandas_udf(run, T.ArrayType(T.FloatType()))(text)


def completed(df: DataFrame, system: str, prompt: str, reply: str, completer: Completer, tries: int = 3, wait: float = 0.5) -> DataFrame:
    """`df` with a column of replies to its prompts. A call that fails for the moment is tried again; one that fails for good, or `tries` times, gives null."""

    def one(p: str) -> str | None:
        for n in range(tries):
            try:
                return completer.complete(system, p)
            except ProviderError as e:
                if not e.retryable:
                    return None
                if n < tries - 1:
                    time.sleep(wait * 2**n)
            except Exception:  # a provider's failure is a null reply, which callers judge
                return None
        return None

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([one(p) for p in s])

    return df.withColumn(reply, F.pandas_udf(run, T.StringType())(F.col(prompt)))
