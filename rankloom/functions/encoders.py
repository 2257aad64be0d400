"""Stand-in encoders used where no trained model is at hand.

An encoder factory is called once per task and returns a function from a list
of texts to a float matrix (dense) or to a list of (term, weight) lists
(sparse). A real model is plugged in the same way: load it in the factory.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np

_WORD = re.compile(r"[^\W_]+")


def _terms(text: str) -> list[str]:
    return _WORD.findall((text or "").lower())


@lru_cache(maxsize=200_000)
def _bucket(term: str, dims: int) -> int:
    return int(hashlib.md5(term.encode()).hexdigest()[:4], 16) % dims


class HashedTermEncoder:
    """Counts of terms in md5 buckets; a deterministic dense encoder."""

    def __init__(self, dims: int = 64):
        self.dims = dims
        self.encoder_id = f"md5-buckets-{dims}"

    def __call__(self):
        dims = self.dims

        def encode(texts):
            out = np.zeros((len(texts), dims))
            for row, text in zip(out, texts):
                for term, n in Counter(_terms(text)).items():
                    row[_bucket(term, dims)] += n
            return out

        return encode


class LogCountEncoder:
    """Terms weighted by ln(1 + count); a deterministic sparse encoder."""

    encoder_id = "log-counts"

    def __call__(self):
        def encode(texts):
            return [
                [(term, math.log1p(n)) for term, n in Counter(_terms(text)).items()]
                for text in texts
            ]

        return encode
