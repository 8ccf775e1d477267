"""A byte-level BPE tokenizer file, encoded exactly as the ``tokenizers`` library does.

The library itself defines the result. Where the file is plain byte-level BPE whose ids follow its
merges, and a text holds only characters that every Unicode version classes alike and no added
token, ``tiktoken`` on the same merges gives the same ids about four times faster; every other text
goes to the library. The tests compare both.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re

import numpy as np

#: Fixed value: the pre-tokenization pattern of byte-level BPE files of this kind.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_UNUSUAL = re.compile("[^\t\n\r -~¡-¬®-ɏ‐-‧€]")


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: printable
    Latin-1 bytes stand for themselves, the others take the code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return out


class ByteTokenizer:
    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            self.fast, self.added = self._fast(json.load(f))

    @functools.cached_property
    def library(self):
        """The library's tokenizer, made when a text first needs it."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.no_padding()
        found.no_truncation()
        return found

    @staticmethod
    def _fast(spec: dict):
        """A tiktoken encoding of the same merges, or None where the file is of another kind."""
        import tiktoken

        added = [t["content"] for t in spec.get("added_tokens") or []]
        model, pre = spec.get("model") or {}, spec.get("pre_tokenizer") or {}
        plain = (model.get("type") == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel"
                 and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not model.get("dropout")
                 and not model.get("ignore_merges") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix"))
        if not plain:
            return None, added
        letter = byte_letters()
        byte_of = {c: b for b, c in letter.items()}
        try:
            ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
        except KeyError:
            return None, added
        last = 255
        for merge in model["merges"]:
            parts = merge.split(" ") if isinstance(merge, str) else merge
            i = model["vocab"].get("".join(parts), -1)
            if i <= last:
                return None, added
            last = i
        if sorted(ranks[bytes([b])] for b in range(256)) != list(range(256)) or len(ranks) != 256 + len(model["merges"]):
            return None, added
        return tiktoken.Encoding("same-merges", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}), added

    def _slow(self, text: str) -> bool:
        return self.fast is None or _UNUSUAL.search(text) is not None or any(a in text for a in self.added)

    def ids(self, text: str) -> np.ndarray:
        """The ids of a whole text, as unsigned 32-bit integers."""
        if self._slow(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(self.fast.encode_ordinary(text), dtype="<u4")

    def count(self, text: str) -> int:
        if self._slow(text):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        return len(self.fast.encode_ordinary(text))


@functools.lru_cache(maxsize=2)
def load(path: str) -> ByteTokenizer:
    """The tokenizer, read once in each worker."""
    return ByteTokenizer(path)


@functools.lru_cache(maxsize=8)
def file_version(path: str) -> str:
    """A digest that changes with the tokenizer's file or the library's release."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


def public_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
