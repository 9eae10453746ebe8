"""Model calls are injected functions; here are the calls in batches, and deterministic stand-ins for embedding, reranking,
analysis and generation.

Stand-ins make plans testable without a model. They aren't meant to match one in quality.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lodestone.sources.scratch import bound_batches

WORD = re.compile(r"\w+")


class _Codes(dict):
    """A word's place in a hashed vector and its sign, as one number. Words recur, so a bounded cache serves most."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        h = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "little")
        code = self[word] = h << 1 & (1 << 64) - 1 | h >> 63
        return code


_codes = _Codes()


def hash_embed(texts: list[str], dim: int = 64) -> np.ndarray:
    """Unit vectors of hashed words."""
    out = np.zeros((len(texts), dim))
    for i, t in enumerate(texts):
        codes = np.fromiter(map(_codes.__getitem__, WORD.findall((t or "").lower())), np.uint64)
        place, up = (codes >> np.uint64(1)) % np.uint64(dim), codes & np.uint64(1)
        out[i] = np.bincount(place.astype(np.int64), np.where(up, 1.0, -1.0), dim)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed(df: DataFrame, text: str, model: Callable[[list[str]], np.ndarray] = hash_embed, prefix: str = "", batch: int = 64) -> DataFrame:
    """df with embedding: the model sees batch texts at a time, behind the prefix that its family asks for. Workers get texts in
    bounded batches."""
    bound_batches(df.sparkSession)

    @F.pandas_udf("array<float>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            rows = [prefix + (t or "") for t in s]
            got = [v for at in range(0, len(rows), batch) for v in model(rows[at : at + batch]).tolist()]
            yield pd.Series(got)

    return df.withColumn("embedding", run(text))


def query_prefix(model_name: str) -> str:
    return "query: " if "e5" in model_name.lower() else ""


def passage_prefix(model_name: str) -> str:
    return "passage: " if "e5" in model_name.lower() else ""


@F.pandas_udf(DoubleType())
def overlap_scorer(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """A stand-in for a cross-encoder: the share of the query's words that the text holds."""
    for q, t in pairs:
        yield pd.Series([len(set(WORD.findall(a.lower())) & set(WORD.findall((b or "").lower()))) / max(1, len(set(WORD.findall(a.lower())))) for a, b in zip(q, t, strict=True)], dtype=float)


def ask(prompt: Column, model: Callable[[list[str]], list[str | None]], batch: int = 16) -> Column:
    """What a language model says to each prompt; it sees batch prompts at a time. Of a batch that fails each prompt is
    tried by itself, and what fails again is null. Write the result before it's read twice: calls cost."""

    @F.pandas_udf("string")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(prompts: list[str]) -> list[str | None]:
            try:
                got = list(model(prompts))
                if len(got) == len(prompts):
                    return got
            except Exception:  # noqa: BLE001 - whatever a client raises
                pass
            return [None] if len(prompts) == 1 else [x for p in prompts for x in one([p])]

        for s in series:
            rows = [p or "" for p in s]
            yield pd.Series([x for at in range(0, len(rows), batch) for x in one(rows[at : at + batch])], dtype=object)

    return run.asNondeterministic()(prompt)


def echo_model(prompts: list[str]) -> list[str | None]:
    """A stand-in for generation that says the prompt behind its length, and fails on every seventh length."""
    if any(len(p) % 7 == 0 for p in prompts):
        raise TimeoutError
    return [f" {len(p)}: {p}\n" for p in prompts]


def analysis_model(prompts: list[str]) -> list[str | None]:
    """A stand-in for analysis: JSON by the prompt's length, malformed on every fifth and failing on every seventh."""
    if any(len(p) % 7 == 0 for p in prompts):
        raise ConnectionError
    kinds = ("legal_rag", "chit_chat", "web_legal_search", "out_of_scope")
    rows = [{"category": kinds[len(p) % 4], "intent": "list", "vehicle_type": "o_to", "standalone_query": f"S{len(p)}", "expanded_queries": [] if len(p) % 3 == 0 else [f" a{len(p)} ", "", "b"]} for p in prompts]
    return ["{" if len(p) % 5 == 0 else json.dumps(r) for p, r in zip(prompts, rows, strict=True)]
