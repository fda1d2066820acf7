"""Places for models: encoders, scorers of pairs, generators, and deterministic stand-ins for use without any.

A stand-in does a model's job in kind, not in quality: its numbers aren't those of the model it stands for.
"""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions import text as t
from .functions.chunking import once

DIM = 64


class Encoder(Protocol):
    dim: int

    def __call__(self, text: Column) -> Column:
        """Text to array<float>."""


class PairScorer(Protocol):
    def __call__(self, query: Column, text: Column) -> Column:
        """A score of 0 to 1."""


class Generator(Protocol):
    def __call__(self, prompt: Column) -> Column:
        """Prompt to text."""


class HashedEncoder:
    """Counts of hashed tokens with signs, scaled to length 1; an empty text is null. R2: a batch of rows at a time."""

    def __init__(self, dim: int = DIM, normalise: bool = True):
        self.dim, self.normalise = dim, normalise

    def __call__(self, text: Column) -> Column:
        dim, normalise = self.dim, self.normalise

        def run(hashes: pa.Array) -> pa.Array:
            n = len(hashes)
            sizes = hashes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            h, row = hashes.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(n), sizes)
            x = np.bincount(row * dim + h % dim, np.where(h >> 32 & 1, 1.0, -1.0), n * dim).reshape(n, dim)
            length = np.linalg.norm(x, axis=1)
            x = (x / np.maximum(length, 1e-300)[:, None] if normalise else x).astype(np.float32)
            values = pa.array(x[length > 0].reshape(-1))
            offsets = np.concatenate([[0], np.cumsum(np.where(length > 0, dim, 0))]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array(length == 0))

        tokens = F.transform(t.bm25_tokens(text), lambda w: F.pmod(F.xxhash64(w), F.lit(1 << 40)))
        return once(F.arrow_udf(run, "array<float>"))(tokens)


def first_sentence(prompt: Column) -> Column:
    """A generator's stand-in: an answer in JSON whose paragraph is the first sentence of the prompt's context."""
    context = F.regexp_extract(prompt, r"(?s)Context:\n(.*?)\n\nQuestion:", 1)
    body = F.regexp_replace(context, r"^Source: [^\n]*\n", "")
    sentence = F.regexp_extract(body, r"(?s)^(.*?[.!?])(?:\s|$)", 1)
    sentence = F.when(sentence != "", sentence).otherwise(F.substring(body, 1, 300))
    title = F.regexp_extract(prompt, r"\n\nQuestion: ([^\n]*)", 1)
    section = F.struct(F.lit("paragraph").alias("type"), sentence.alias("content"))
    return F.when(context == "", F.to_json(F.struct(title.alias("title"), F.lit("Nothing was found.").alias("fallback")))).otherwise(F.to_json(F.struct(title.alias("title"), F.array(section).alias("sections"))))


def hypothetical(query: Column, generator: Generator | None = None) -> Column:
    """A sentence that might answer a query, to be encoded in its place."""
    return generator(F.concat(F.lit("Answer in one sentence: "), query)) if generator else F.concat(query, F.lit(" is described in the documents."))
