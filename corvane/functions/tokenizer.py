"""A public tokenizer of byte-level BPE, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import os

#: The vocabulary file (ranks of a byte-level BPE), present on every machine of the cluster.
VOCABULARY = os.environ.get("CORVANE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the split pattern that belongs to byte-level BPE vocabularies of 50k tokens.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LOADED: dict = {}


def encoding(path: str = VOCABULARY):
    """The tokenizer of a vocabulary file, loaded once a process."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]
