"""Public tokenizers by path. Files are described in the README of their folder."""

from __future__ import annotations

import base64
import os

#: Folder of the vocabulary files; a parameter of every operator that measures in tokens.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's tokenizer splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_LOADED: dict[str, object] = {}


def encoding(path: str | None = None):
    """A tiktoken encoding from a ranks file, loaded once per process."""
    path = path or f"{TOKENIZERS}/{VOCABULARY}"
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]
