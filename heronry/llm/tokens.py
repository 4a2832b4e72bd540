"""Token ids of texts with a byte-level BPE vocabulary.

The default vocabulary's file in rank form gives the ids of the tokenizer file
of the same name, several times as fast; the tests hold both against each
other. As with that file, the string of the special token in a text becomes
its id. Any other path is a tokenizer file, which is used itself.

The regex engine of the rank form gives up on very long whitespace runs. A text
that it refuses is encoded with the tokenizer file itself.
"""

from __future__ import annotations

import numpy as np

#: The pattern of the vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The special token and its id (fixed values).
SPECIAL = {"<|endoftext|>": 50256}

_ENCODERS: dict = {}
_FILES: dict = {}


def default_path() -> str:
    """The vocabulary of 50,257 ids among the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str):
    """One encoder a worker process."""
    if path not in _ENCODERS:
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _ENCODERS[path] = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return _ENCODERS[path]


def from_file(path: str, text: str) -> np.ndarray:
    """Ids of a text with a tokenizer file."""
    if path not in _FILES:
        from tokenizers import Tokenizer

        _FILES[path] = Tokenizer.from_file(path)
    return np.array(_FILES[path].encode(text, add_special_tokens=False).ids, np.uint32)


def ids_of(path: str, text: str) -> np.ndarray:
    """Ids of one text."""
    if not path.endswith(".tiktoken"):
        return from_file(path, text)
    special = "all" if any(s in text for s in SPECIAL) else set()
    try:
        return encoder(path).encode_to_numpy(text, allowed_special=special, disallowed_special=())
    except ValueError:
        return from_file(path.removesuffix(".tiktoken") + ".json", text)


def encode(path: str, texts: list[str | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in a row, number of ids of each); `end` is added to each text; null is empty."""
    ids = [ids_of(path, t or "") for t in texts]
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    count = size + (end is not None)
    flat = np.empty(int(count.sum()), np.uint32)
    if end is not None:
        flat[np.cumsum(count) - 1] = end
    for x, at in zip(ids, (np.cumsum(count) - count).tolist()):
        flat[at : at + len(x)] = x
    return flat, count


def in_16_bits(ids: np.ndarray) -> np.ndarray:
    """The ids as 16-bit numbers; an error if one is too large."""
    if len(ids) and ids.max() > 0xFFFF:
        raise ValueError("the vocabulary has ids beyond 16 bits")
    return ids.astype("<u2")
