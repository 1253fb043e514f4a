"""Seams for models: callables with deadlines and retries, and offline defaults that always answer alike."""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSIONS = 64


def with_deadline(call: Callable[[], str], seconds: float) -> str:
    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(call).result(seconds)
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


def with_retries(call: Callable[[], str], retries: int) -> str:
    for left in range(retries, -1, -1):
        try:
            return call()
        except Exception:
            if not left:
                raise
    raise AssertionError


def embed_text(text: str, dimensions: int = DIMENSIONS) -> list[float]:
    """A hashing embedder: signed counts of lower-case words and neighbour pairs, scaled to length 1."""
    words = re.findall(r"\w+", (text or "").lower())
    out = np.zeros(dimensions)
    for gram in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]:
        h = int.from_bytes(hashlib.md5(gram.encode()).digest()[:8], "big")
        out[h % dimensions] += 1.0 if h >> 63 else -1.0
    size = float(np.linalg.norm(out))
    return (out / size if size else out).tolist()


class Busy(Exception):
    """The service asks to wait; ``seconds`` is its delay."""

    def __init__(self, seconds: float = 0.0):
        super().__init__(f"wait {seconds} s")
        self.seconds = seconds


def embed_many(texts: list[str], batch: Callable[[list[str]], list[list[float]]], one: Callable[[str], list[float]], size: int = 50, retries: int = 2, sleep: Callable[[float], None] = time.sleep) -> list[list[float]]:
    """Vectors of the texts in calls of ``size``; a busy service is asked again after its delay and a second, and a batch that fails otherwise is taken text by text."""

    def patient(call: Callable[[], list]) -> list:
        for left in range(retries, -1, -1):
            try:
                return call()
            except Busy as e:
                if not left:
                    raise
                sleep(e.seconds + 1)
        raise AssertionError

    out: list[list[float]] = []
    for at in range(0, len(texts), size):
        own = texts[at : at + size]
        try:
            found = patient(lambda own=own: batch(own))
            if len(found) != len(own):
                raise ValueError("a vector for each text is wanted")
        except Busy:
            raise
        except Exception:
            found = [patient(lambda t=t: one(t)) for t in own]
        out += found
    return out


def embed(text: Column, model: Callable[[str], list[float]] = embed_text) -> Column:
    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(model)

    return run(text)


def rewrite_words(query: str) -> str:
    """The default rewriter: filler words dropped."""
    filler = {"please", "can", "could", "you", "tell", "me", "the", "a", "an", "do", "i", "is", "are", "to", "of"}
    return " ".join(w for w in query.rstrip("?!. ").split() if w.lower() not in filler)


def rank_by_overlap(query: str, candidates: list[dict]) -> str:
    """The default reranker: candidates by the share of the query's words that they have."""
    words = set(re.findall(r"\w+", query.lower()))
    order = sorted(range(len(candidates)), key=lambda i: (-len(words & set(re.findall(r"\w+", (candidates[i]["content"] or "").lower()))), i))
    return json.dumps({"rankedIds": [candidates[i]["chunk_id"] for i in order], "diagnostics": []})


__all__ = ["Busy", "Late", "embed", "embed_many", "embed_text", "rank_by_overlap", "rewrite_words", "with_deadline", "with_retries"]
