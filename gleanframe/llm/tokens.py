"""Token counts of whole texts by a public byte-level BPE, one encoder per worker process."""

from __future__ import annotations

import base64
import functools

import pandas as pd

# Fixed value: the split pattern that belongs to the byte-level BPE rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def counts(texts: pd.Series, path: str) -> list[int]:
    enc = encoder(path)
    return [0 if t is None else len(enc.encode_ordinary(t)) for t in texts]
