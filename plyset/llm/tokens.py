"""Token ids of a byte-level BPE file, exactly those of the ``tokenizers`` library.

The library's own encoder spends most of its time around the merges. Where the file's merges are
ordered as its ids are (checked when it is loaded), the same vocabulary and split pattern give the
same ids through ``tiktoken``; any other file, a text that holds an added token and a text that
the fast encoder refuses go to ``tokenizers``. tests/llm compare the two.
"""

from __future__ import annotations

import json

import numpy as np

#: The split of the byte-level pre-tokenizer: a fixed value of the format.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that byte-level BPE files write for each byte: printable bytes stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in set(plain)):
        letters[chr(256 + k)] = b
    return letters


class Encoder:
    """``encode(text)`` gives an uint32 array. ``spec`` is the tokenizer file's content."""

    def __init__(self, spec: bytes):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_buffer(spec)
        parsed = json.loads(spec)
        self.added = [t["content"] for t in parsed.get("added_tokens", [])]
        self.fast = self._fast(parsed)

    @staticmethod
    def _fast(parsed: dict):
        model, pre = parsed["model"], parsed.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and parsed.get("normalizer") is None and pre.get("type") == "ByteLevel"
        if not plain or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("ignore_merges"):
            return None
        if model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            return None
        letters = byte_letters()
        added = {t["content"] for t in parsed.get("added_tokens", [])}
        vocabulary = {w: i for w, i in model["vocab"].items() if w not in added}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        order = [vocabulary.get(a + b, -1) for a, b in merges]
        if any(x >= y for x, y in zip(order, order[1:])) or len(merges) + 256 != len(vocabulary):
            return None
        import tiktoken

        ranks = {bytes(letters[c] for c in w): i for w, i in vocabulary.items()}
        return tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None and not any(t in text for t in self.added):
            try:
                return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), np.uint32)
            except ValueError:  # the split of very long white space exceeds its limits
                pass
        return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


_loaded: dict[int, Encoder] = {}


def encoder(spec: bytes) -> Encoder:
    """One encoder per worker process and file."""
    key = hash(spec)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Encoder(spec)
    return _loaded[key]
