"""A byte-level BPE tokenizer file, encoded as the ``tokenizers`` library does (runs inside tasks)."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: The split of the ByteLevel pre-tokenizer (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, then from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Ids of texts and bytes of ids.

    Where the file is a plain byte-level BPE whose ids follow the order of its merges, ``tiktoken`` does
    the work: it merges the neighbours whose joint token has the least rank.  That gives the same ids:
    inside the span of a token no merge crosses the span's ends, so the merges before its last one are
    those of the token alone, and these end in the pair that the file lists.  ``exact`` tells if so; any
    other file goes through ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.slow = Tokenizer.from_file(path)
        self.slow.no_padding()
        self.slow.no_truncation()
        model, pre, letters = spec["model"], spec.get("pre_tokenizer") or {}, byte_letters()
        added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec.get("added_tokens") or [])
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        self.exact = (plain and model["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                      and not pre.get("add_prefix_space") and not spec.get("normalizer") and not model.get("ignore_merges")
                      and not model.get("dropout") and all(c in vocab and vocab[c] < 256 for c in letters)
                      and all(vocab.get("".join(m)) == 256 + i for i, m in enumerate(merges)))
        if self.exact:
            ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in added}
            self.fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=added)
            table = {i: t for t, i in ranks.items()} | {i: t.encode() for t, i in added.items()}
            self.pieces = [table.get(i, b"") for i in range(max(table) + 1)]
            self.sizes = np.array([len(p) for p in self.pieces], np.int64)

    def encode(self, text: str) -> np.ndarray:
        if self.exact:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, ids outside the vocabulary are left out."""
        if self.exact:
            known = len(self.pieces)
            return b"".join([self.pieces[i] for i in ids.tolist() if 0 <= i < known]).decode("utf-8", "replace")
        return self.slow.decode(ids.tolist(), skip_special_tokens=False)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for a worker process."""
    return Encoder(path)
