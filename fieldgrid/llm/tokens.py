"""Byte-level BPE ids of whole texts.

The vocabulary is a ``tokenizers`` file. Its merges are in the order of their
ids, so the same ids come from rank-ordered byte merging, which tiktoken does
several times faster; the file is read once per worker and checked for that
order. Texts with characters beyond extended Latin, where the two libraries'
Unicode tables could differ in age, are encoded by ``tokenizers`` itself.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The splitting pattern of byte-level BPE. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_COMMON = re.compile("[\x00-ɏ‐-‧‰-⁞€]*")
_LOADED: dict[str, ByteBpe] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in the file: itself if printable, else the next one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True  # their strings are ordinary text here
        self.fast = self._ranked(path)

    @staticmethod
    def _ranked(path: str):
        """The same vocabulary as byte ranks, or None if its ids don't follow its merges."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model, byte = data["model"], byte_alphabet()
        special = {t["content"] for t in data.get("added_tokens", [])}
        merged = [m.replace(" ", "", 1) if isinstance(m, str) else "".join(m) for m in model["merges"]]
        ids = [model["vocab"][m] for m in merged]
        if ids != sorted(ids) or len(merged) + 256 + len(special) != len(model["vocab"] | dict.fromkeys(special)):
            return None
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def of(cls, path: str) -> ByteBpe:
        """One per worker process and vocabulary."""
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    def encode(self, text: str) -> list[int]:
        if self.fast and _COMMON.fullmatch(text):
            return self.fast.encode_ordinary(text)
        return self.whole.encode(text, add_special_tokens=False).ids


def count_tokens(text: Column, vocabulary: str | None = None) -> Column:
    """Ids of a text under a byte-level BPE vocabulary, counted; 0 for null."""
    path = vocabulary or default_vocabulary()

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = ByteBpe.of(path)
        for texts in batches:
            yield pd.Series([len(bpe.encode(t)) if t else 0 for t in texts], dtype="int64")

    return count(text)
