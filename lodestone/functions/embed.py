"""Vectors for texts without a model: signed hashes of their code tokens, by inverse square root of count, of norm 1.

A stand-in behind a plain interface (texts to rows of numbers); another embedder can be given wherever one is taken.
Equal texts have equal vectors, and texts that share tokens lie near each other; meaning beyond that it doesn't know.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np

DIMS = 256
_TOKEN = re.compile(r"[^\W_]{2,}")


def pieces(text: str | None) -> list[str]:
    """Lower-case tokens: whole ones and, where case changes inside, their parts."""
    out = []
    for w in _TOKEN.findall(text or ""):
        parts = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\dA-Za-z]+", w)
        out += [w.lower(), *(p.lower() for p in parts if len(parts) > 1)]
    return out


def hashed(texts: list[str | None]) -> np.ndarray:
    out = np.zeros((len(texts), DIMS))
    for row, text in zip(out, texts, strict=True):
        for token, n in Counter(pieces(text)).items():
            h = zlib.crc32(token.encode("utf-8", "surrogatepass"))
            row[h % DIMS] += n**0.5 * (1 if h >> 31 else -1)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)
