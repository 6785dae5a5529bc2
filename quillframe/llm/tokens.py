"""Ids of a byte-level BPE vocabulary that is given as files; nothing is trained or copied."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np

# Both libraries give the same ids for text in these alphabets (tests/llm/test_tokens.py); text with any
# other character, or with the text form of a special token, goes through tokenizers.
_OTHER = re.compile("[^\x00-ɏ‐-‧]|<\\|")


class Encoder:
    """``encode(text)`` as tokenizers gives it for the JSON file, without added special tokens.

    The rank file holds the same vocabulary; tiktoken reads it and is about five times as fast.
    """

    def __init__(self, json_path: str, ranks_path: str | None, pattern: str | None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(json_path)
        self.fast = None
        if ranks_path is not None:
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding(
                ranks_path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
            )

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or _OTHER.search(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return np.array(self.fast.encode_ordinary(text), dtype=np.uint32)

    def plain(self, text: str) -> np.ndarray:
        """Ids with the strings of special tokens taken as ordinary text."""
        if self.fast is not None:
            return np.array(self.fast.encode_ordinary(text), dtype=np.uint32)
        self.slow.encode_special_tokens = True
        ids = self.slow.encode(text, add_special_tokens=False).ids
        self.slow.encode_special_tokens = False
        return np.array(ids, dtype=np.uint32)


@lru_cache(maxsize=4)
def encoder(name: str = "byte_bpe_50k") -> Encoder:
    """Encoder of the public vocabulary ``name``, opened once per worker."""
    import os

    import public_tokenizers as public

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(
        public.path(f"{name}.json"), public.path(f"{name}.tiktoken"), public.PATTERN
    )
