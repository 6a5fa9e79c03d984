"""The byte-level encoding of a rank file, shared by packing and chat formatting."""

from __future__ import annotations

import re

#: Longer runs of white space are encoded in parts: the library's pattern goes back over
#: a whole run and gives up on very long ones.
LONGEST_SPACE = 50_000
_SPACE = re.compile(rf"\s{{{LONGEST_SPACE}}}")

_encodings: dict[str, object] = {}
_spellings: dict[str, list[bytes]] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoding(vocabulary: str):
    """The encoding; built once a worker. It has no special tokens, so every string is
    ordinary text and ids from ``n_vocab`` on are free."""
    if vocabulary not in _encodings:
        import base64

        import public_tokenizers
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _encodings[vocabulary] = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[vocabulary]


def encode(encoder, text: str) -> list[int]:
    """Ids whose bytes are those of ``text``."""
    if len(text) < LONGEST_SPACE or not _SPACE.search(text):
        return encoder.encode_ordinary(text)
    ids, at = [], 0
    for found in _SPACE.finditer(text):
        ids += encoder.encode_ordinary(text[at: found.end()])
        at = found.end()
    return ids + encoder.encode_ordinary(text[at:])


def spellings(vocabulary: str) -> list[bytes]:
    """The bytes of every id."""
    if vocabulary not in _spellings:
        encoder = encoding(vocabulary)
        _spellings[vocabulary] = [encoder.decode_single_token_bytes(i) for i in range(encoder.n_vocab)]
    return _spellings[vocabulary]
