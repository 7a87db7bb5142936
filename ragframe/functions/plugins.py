"""Replaceable model callables (embedder, chat completer, judge, parsers).

Each plug-in is a *batch* function over pandas objects, called inside
``mapInPandas`` on Arrow batches: Spark partitions and shuffles the work, the
plug-in only sees one batch. The defaults are deterministic and offline so
every operator can run (and be tested) without a model server.
"""

from __future__ import annotations

import hashlib
import html
import re
from typing import Callable

import numpy as np
import pandas as pd

Embedder = Callable[[pd.Series], list]            # texts -> list of float vectors
Completer = Callable[[pd.DataFrame], pd.Series]   # messages per prompt -> answer text
Judge = Callable[[pd.DataFrame], pd.Series]       # cases -> score in [0, 1]

_WORD = re.compile(r"[^\W_]+", re.UNICODE)


def token_bucket(token: str, dim: int) -> tuple[int, float]:
    """Bucket and sign of a token, from its MD5 (which SQL engines have too): the
    first four bytes modulo ``dim``, and the first bit of the fifth."""
    d = hashlib.md5(token.encode("utf-8", "replace")).digest()
    return int.from_bytes(d[:4], "big") % dim, 1.0 if d[4] >= 128 else -1.0


def hashed_embedder(dim: int = 64) -> Embedder:
    """Feature-hashing embedder: lower-cased word tokens hashed into ``dim``
    signed buckets, L2-normalised, float32. Each distinct token of a batch is
    hashed once; the counts of all its texts are one ``bincount``."""

    def embed(texts: pd.Series) -> list:
        ids: dict[str, int] = {}
        rows, cols = [], []
        for i, t in enumerate(texts):
            toks = _WORD.findall(t.lower()) if t is not None else []
            rows.append(np.full(len(toks), i))
            cols.extend(ids.setdefault(tok, len(ids)) for tok in toks)
        n = len(rows)
        if not n:
            return []
        hashed = [token_bucket(tok, dim) for tok in ids]
        bucket = np.array([h[0] for h in hashed], dtype=np.int64)
        sign = np.array([h[1] for h in hashed], dtype=np.float64)
        cols = np.array(cols, dtype=np.int64)
        counts = np.bincount(np.concatenate(rows) * dim + (bucket[cols] if len(cols) else 0),
                             weights=sign[cols] if len(cols) else None, minlength=n * dim)
        counts = counts.astype(np.float64).reshape(n, dim)
        norm = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        return list(np.where(norm > 0, counts / np.where(norm > 0, norm, 1.0), counts).astype(np.float32))

    return embed


def extractive_completer() -> Completer:
    """Stand-in for a chat model: answers with the retrieved context found in the
    last user message (all of it, runs of white space as one space), or "I don't
    know." when it is empty. Input frame has columns ``messages`` (list of {role,
    content})."""
    ctx_re = re.compile(r"<context>\s*(.*?)\s*</context>", re.S)

    def complete(batch: pd.DataFrame) -> pd.Series:
        answers = []
        for msgs in batch["messages"]:
            user = ""
            for m in (msgs if msgs is not None else []):
                if m["role"] == "user":
                    user = m["content"] or ""
            found = ctx_re.search(user)
            words = (found.group(1) if found else "").split()
            answers.append(" ".join(words) if words else "I don't know.")
        return pd.Series(answers, dtype=object)

    return complete


def html_to_text(raw: str | None) -> str | None:
    """Tiny HTML-to-text parser (per-row helper of B1): drop script/style/head,
    strip tags, unescape entities, collapse blank runs."""
    if raw is None:
        return None
    s = re.sub(r"(?is)<(script|style|head)\b.*?</\1\s*>", " ", raw)
    s = re.sub(r"(?s)<[^>]*>", " ", s)
    s = html.unescape(s)
    return re.sub(r"[ \t\r\f\v]+", " ", s).strip()


def default_parsers() -> dict[str, Callable[[bytes], str]]:
    """MIME type -> bytes parser. Binary office formats are not bundled."""
    def text(b: bytes) -> str:
        return b.decode("utf-8", errors="replace")

    def htm(b: bytes) -> str:
        return html_to_text(b.decode("utf-8", errors="replace")) or ""

    return {"text/plain": text, "text/csv": text, "application/json": text,
            "text/xml": text, "application/xml": text, "text/html": htm,
            "application/xhtml+xml": htm}
