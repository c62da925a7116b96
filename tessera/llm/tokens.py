"""The encoder of `tessera.functions.encoder` as the operators keep it: one a Python worker."""

from __future__ import annotations

import hashlib

from tessera.functions import encoder as own
from tessera.functions.encoder import make_of, tokenizer_source  # noqa: F401
from tessera.llm import common

CACHE = own.CACHE


class Encoder(own.Encoder):
    def __init__(self, source: str):
        super().__init__(source, CACHE)


def encoder(source: str) -> Encoder:
    """One encoder a Python worker, so what it knows outlives a task."""
    return common.resident("encoder" + hashlib.sha256(source.encode()).hexdigest(), lambda: Encoder(source))
