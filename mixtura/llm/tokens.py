"""Token ids of whole texts by a public byte-level BPE vocabulary, as packed bytes."""

from __future__ import annotations

import base64

import numpy as np


class _Memo(dict):
    """Ids of a word as bytes, found once; emptied when full, so memory is bounded."""

    def __init__(self, encode, limit: int):
        super().__init__()
        self._encode, self._limit = encode, limit

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self._limit:
            self.clear()
        ids = self[word] = self._encode(word)
        return ids


class BpeEncoder:
    """Encodes as ``tokenizers`` does with ``{name}.json`` and add_special_tokens=False.

    The pattern that parts text before BPE never joins a space to what stands before it, so between
    single spaces a text falls into parts that are encoded one by one and remembered. Texts with
    other runs of spaces are encoded in one piece, and texts that hold the special token's string
    by ``tokenizers`` itself.
    """

    SPECIAL = "<|endoftext|>"

    def __init__(self, name: str = "byte_bpe_50k", limit: int = 300_000):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.dtype = np.dtype("<u2" if len(ranks) < 1 << 16 else "<u4")
        self._json, self._slow = public_tokenizers.path(f"{name}.json"), None
        self._memo = _Memo(lambda word: self._pack(self._bpe.encode_ordinary(" " + word)), limit)

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=self.dtype).tobytes()

    def packed(self, text: str) -> bytes:
        if self.SPECIAL in text:
            if self._slow is None:
                from tokenizers import Tokenizer

                self._slow = Tokenizer.from_file(self._json)
            return self._pack(self._slow.encode(text, add_special_tokens=False).ids)
        parts = text.split(" ")
        if "" in parts:
            return self._pack(self._bpe.encode_ordinary(text))
        return self._pack(self._bpe.encode_ordinary(parts[0])) + b"".join(map(self._memo.__getitem__, parts[1:]))
