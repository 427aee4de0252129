"""Tokenizer files opened once in each Python worker."""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

#: Fixed value: the published pre-tokenizer pattern of byte-level BPE vocabularies of this kind.
BYTE_LEVEL_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Normalizer and word pattern of lower-casing word BPE vocabularies of this kind.
LOWER_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
LOWER_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_PROBE = "It's 12 naïve  tests,\n\n\tof_spaces   and ŝigns…  'll 　x<|endoftext|>end  "


def public_path(name: str) -> str:
    """The place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(4)
def library(path: str):
    """The tokenizers library's object, single-threaded, without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


@lru_cache(4)
def unnormalized(path: str):
    """The library's object without its normalizer, and the texts of its special tokens, for texts that ``lowered`` takes.

    None where the file isn't a lower-casing word BPE whose pattern leaves white space out, so that collapsing it changes nothing.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    normalizer, pre = spec.get("normalizer") or {}, (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    split = {"type": "Split", "pattern": {"Regex": LOWER_PATTERN}, "behavior": "Removed", "invert": True}
    if normalizer.get("normalizers") != LOWER_NORMALIZER or pre[0] != split or any(t["normalized"] for t in spec["added_tokens"]):
        return None
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    t.normalizer = None
    return t, tuple(x["content"].lower() for x in spec["added_tokens"])


def lowered(text: str, special: tuple[str, ...]) -> str | None:
    """The text as that normalizer leaves it but for white space; None if it holds more than Latin letters and signs, or a special token's text in any case.

    Below U+0180 nothing composes and every letter but U+0130 has one lower-case letter.
    """
    if text.isascii() or (max(text) < "\u0180" and "\u0130" not in text):
        out = text.lower()
        if not any(x in out for x in special):
            return out
    return None


def _printable() -> dict[str, int]:
    """The byte that each printable stand-in of a byte-level vocabulary means."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@lru_cache(4)
def _ranked(path: str):
    """The same vocabulary as a rank table, or None where the file isn't a plain byte-level BPE."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = (
        model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        and not spec.get("normalizer") and not model.get("dropout") and not model.get("ignore_merges")
        and not any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in spec["added_tokens"])
    )
    if not plain:
        return None
    import tiktoken

    byte = _printable()
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items()}
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    fast = tiktoken.Encoding("file", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks={k: v for k, v in ranks.items() if v not in special.values()}, special_tokens=special)
    same = fast.encode(_PROBE, allowed_special="all") == library(path).encode(_PROBE, add_special_tokens=False).ids
    return fast if same else None


def encode(path: str, text: str) -> np.ndarray:
    """Ids of ``text`` as the tokenizers library gives them without special tokens added, as uint32.

    A plain byte-level BPE runs through the rank-table encoder of the same
    vocabulary (several times faster, held equal by a probe and by tests); any
    other file, and a text that encoder refuses, through the library itself.
    """
    fast = _ranked(path)
    if fast is not None:
        try:
            return np.array(fast.encode(text, allowed_special="all"), dtype=np.uint32)
        except BaseException as e:  # the regex engine's panics are no Exceptions
            if not isinstance(e, Exception) and type(e).__name__ != "PanicException":
                raise
    return np.array(library(path).encode(text, add_special_tokens=False).ids, dtype=np.uint32)
