"""Byte-level BPE ids from a public vocabulary file, one encoder per Python worker.

Two files hold one vocabulary, for two libraries: the faster one takes texts up to ``LONG_TEXT`` characters.
"""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import numpy as np

#: Longer texts go to the slower library, whose pre-tokenizer does not recurse over long runs.
LONG_TEXT = 1 << 20


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def special_ids(json_path: str) -> dict[str, int]:
    """The special tokens that the vocabulary names, with their ids."""
    with open(json_path, encoding="utf-8") as file:
        return {token["content"]: token["id"] for token in json.load(file)["added_tokens"] if token["special"]}


@lru_cache(maxsize=2)
def encoder(paths: tuple[str, str]):
    import public_tokenizers
    import tiktoken

    with open(paths[1], "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special_ids(paths[0]))


@lru_cache(maxsize=4)
def tokenizer(json_path: str, special: bool = False):
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(json_path)
    loaded.encode_special_tokens = not special
    return loaded


def encode(text: str, paths: tuple[str, str], special: bool = False) -> np.ndarray:
    """The ids of ``text`` as unsigned 32-bit integers.

    A special token's string in a text is ordinary text, or with ``special`` its own id, as the tokenizer itself has it.
    """
    if len(text) > LONG_TEXT:
        ids = tokenizer(paths[0], special).encode(text, add_special_tokens=False).ids
    elif special and any(token in text for token in special_ids(paths[0])):
        ids = encoder(paths).encode(text, allowed_special="all", disallowed_special=())
    else:
        ids = encoder(paths).encode_ordinary(text)
    return np.asarray(ids, dtype="<u4")


def decode(ids: np.ndarray, paths: tuple[str, str]) -> str:
    return encoder(paths).decode_bytes(ids.tolist()).decode("utf-8", errors="replace")
