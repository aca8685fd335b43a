"""Public byte-level BPE vocabularies for tasks; the files stay where they are and their path is a parameter."""

from __future__ import annotations

import base64
import functools
import pathlib

import numpy as np

#: Fixed values of the vocabulary: its word pattern and its one special token.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = {"<|endoftext|>": 50256}
DEFAULT_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"


class Encoder:
    """Ids of a text, and how many bytes each id stands for. The ids equal those of the same vocabulary in library ``tokenizers``."""

    def __init__(self, path: str):
        import tiktoken

        lines = pathlib.Path(path).read_bytes().split(b"\n")
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line)}
        self.encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
        self.sizes = np.zeros(max(max(ranks.values()), *SPECIAL.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)
        for token, rank in SPECIAL.items():
            self.sizes[rank] = len(token.encode())

    def ids(self, text: str) -> np.ndarray:
        """Ids as unsigned 32-bit numbers; the string of a special token is that token, as in ``tokenizers``."""
        return self.encoding.encode_to_numpy(text, allowed_special="all")

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First character and character after the last of every token; a token with part of a character touches all of it."""
        ids = self.ids(text)
        ends = np.cumsum(self.sizes[ids])
        starts = ends - self.sizes[ids]
        if len(text) == (ends[-1] if len(ends) else 0):
            return starts, ends
        leads = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
        place = np.cumsum(leads) - 1
        return place[starts], place[ends - 1] + 1


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per path and Python worker."""
    return Encoder(path)
