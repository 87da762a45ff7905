"""Token ids of a public byte-level BPE vocabulary, given by the path of its ``tokenizer.json``.

The ids are those of the ``tokenizers`` library. They are computed by ``tiktoken`` with the same vocabulary, which
takes a quarter of the time; texts that hold one of the vocabulary's added tokens or a run of more than LONG_SPACE
white-space characters (for which its regular expression needs too deep a stack), and vocabularies of any other form,
go to ``tokenizers`` itself. A test holds both against each other.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable

import numpy as np

#: The pre-tokenisation pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

LONG_SPACE = 100_000
_SPACE = re.compile(r"\s++")


def _byte_of_symbol() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = sorted(set(range(256)) - shown)
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


def _plain(spec: dict) -> bool:
    """Whether the vocabulary is byte-level BPE with the usual pattern, ranked by id."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    merges = [x.split(" ") if isinstance(x, str) else x for x in model.get("merges", [])]
    return (
        spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        and (found := [model["vocab"].get("".join(x), -1) for x in merges]) == sorted(found) and -1 not in found
    )


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """A function from a text to its ids."""

    @functools.cache  # few texts need it, and it takes as much memory as the fast one
    def exact():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    def slow(text: str) -> np.ndarray:
        return np.array(exact().encode(text, add_special_tokens=False).ids, np.uint32)

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if not _plain(spec):
        return slow
    import tiktoken

    symbols = _byte_of_symbol()
    added = tuple(x["content"] for x in spec.get("added_tokens", []))
    ranks = {bytes(symbols[c] for c in token): n for token, n in spec["model"]["vocab"].items() if token not in added}
    fast = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(x in text for x in added) or len(text) > LONG_SPACE and any(m.end() - m.start() > LONG_SPACE for m in _SPACE.finditer(text)):
            return slow(text)
        return np.array(fast.encode_ordinary(text), np.uint32)

    return encode
