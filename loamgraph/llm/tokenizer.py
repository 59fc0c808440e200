"""Byte-level BPE ids for whole Arrow batches.

The vocabulary file is the `tokenizers` library's; its merges are run by tiktoken, which
is several times as fast and gives the same ids (tests compare them). An added token's
string in a text is that one token, as in the library. A text that tiktoken can't split
(runs of about a million spaces) goes to the library itself.
"""

from __future__ import annotations

import json
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa

from .batches import SLICE_BYTES

#: The published split pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file: printable Latin-1
    stands for itself, the others take the code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        letters = _byte_letters()
        if any(x.get(f) for x in model.get("added_tokens", ()) for f in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"added tokens that take in what is around them: {path}")
        added = {x["content"]: x["id"] for x in model.get("added_tokens", ())}
        ranks = {bytes(letters[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in added}
        self.path = path
        self._bpe = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
        ranks |= {t.encode(): i for t, i in added.items()}
        size = max(ranks.values()) + 1
        self.n_bytes = np.zeros(size, dtype=np.int64)
        self.ends_sentence = np.zeros(size, dtype=bool)
        for token, i in ranks.items():
            self.n_bytes[i] = len(token)
            self.ends_sentence[i] = b"\n" in token or token.rstrip(b" \t\"')").endswith((b".", b"!", b"?"))

    @cached_property
    def _library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _encode(self, text: str) -> list[int]:
        try:
            return self._bpe.encode(text, allowed_special="all", disallowed_special=())
        except ValueError:  # the pattern's backtracking ran out of stack
            return self._library.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, and each text's first position in it (n + 1)."""
        # A lone surrogate can't come from UTF-8, so no text fails here.
        found = [np.asarray(self._encode(t), dtype=np.uint32) for t in texts]
        at = np.concatenate(([0], np.cumsum([len(x) for x in found], dtype=np.int64)))
        return np.concatenate(found) if found else np.zeros(0, np.uint32), at


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(path)


def text_groups(texts: pa.Array, limit: int = SLICE_BYTES):
    """(first row, texts) for runs of rows of about `limit` bytes."""
    held, size, first = [], 0, 0
    for i, t in enumerate(texts.to_pylist()):
        held.append(t)
        size += len(t)
        if size >= limit:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held
