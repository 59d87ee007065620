"""Token ids of a public byte-level vocabulary.

The vocabulary, its ranks and its special tokens are read from a tokenizer file of the ``tokenizers`` library, whose ids
these are; the encoding itself is done by ``tiktoken``, which gives the same ids several times faster (a test holds the
two against each other). Its pattern can't go through blanks in a row without end; such a text is encoded by ``tokenizers``.
"""

from __future__ import annotations

import functools
import json

# Fixed value: the pattern by which byte-level vocabularies of this kind split a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_symbols() -> dict[str, int]:
    """The printable symbol that stands for each byte in such a file: itself where it prints, else from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(2)
def encoding(path: str):
    """The encoding of a tokenizer file, once for each Python worker."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    of = byte_symbols()
    ranks = {bytes(of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


@functools.lru_cache(2)
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def ids(path: str, text: str) -> list[int]:
    try:
        return encoding(path).encode(text, allowed_special="all", disallowed_special=())
    except ValueError:
        return library(path).encode(text, add_special_tokens=False).ids
