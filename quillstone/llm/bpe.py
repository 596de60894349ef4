"""Exact use of a byte-level BPE tokenizer inside Python workers.

Ids of whole texts come from an encoder of ranks where the file allows it, else from the
tokenizer itself; both give the same ids. Nothing is kept between texts.

A byte-level pre-tokenizer always starts a new pre-token at a single space that
stands between two characters which are no white space. Cutting a text there gives units whose ids, put
one after the other, are the ids of the whole text.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

#: Cuts of a text that has white space next to a space.
_CUT = re.compile(r"(?<=\S)(?= \S)")
_ADJACENT = re.compile(r"\s | \s")


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def units(text: str) -> list[str]:
    """Parts of ``text`` that can be encoded on their own; joined by nothing they give the text, but for the
    plain case, where each unit after the first lacks its leading space (see ``plain``)."""
    return _CUT.split(text)


def plain(text: str) -> bool:
    """Whether every space of ``text`` is a cut, so that ``text.split(" ")`` finds the units."""
    return not (_ADJACENT.search(text) or text[:1] == " " or text[-1:] == " ")


def encode(path: str, texts: list[str]) -> list[list[int]]:
    """Ids as the library gives them without added special tokens."""
    t = tokenizer(path)
    batch = getattr(t, "encode_batch_fast", t.encode_batch)
    return [e.ids for e in batch(texts, add_special_tokens=False)]


#: The pre-tokens of a byte-level tokenizer (fixed value).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longest run without a cut that goes to the rank encoder.
LONG_RUN = re.compile(r"\s{5000}|\S{50000}")


def _byte_chars() -> dict[str, int]:
    """The characters by which a byte-level vocabulary writes bytes: printable bytes stand for
    themselves, the others for U+0100 and on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(other)}


@lru_cache(maxsize=4)
def rank_encoder(path: str):
    """A tiktoken encoding with the vocabulary of a ``tokenizers`` file, or None where the file isn't plain
    byte-level BPE whose merges are in the order of their ids; only then do both give the same ids."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges") or []]
    vocab = model.get("vocab") or {}
    if (
        model.get("type", "BPE") != "BPE"
        or model.get("dropout")
        or model.get("ignore_merges")
        or spec.get("normalizer")
        or pre.get("type") != "ByteLevel"
        or pre.get("add_prefix_space")
        or not pre.get("use_regex", True)
        or any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip"))
    ):
        return None
    ids = [vocab["".join(m)] for m in merges]
    special = {t["content"]: t["id"] for t in added}
    if ids != sorted(ids) or len(ids) + 256 != len(vocab.keys() - special.keys()):
        return None
    value = _byte_chars()
    ranks = {bytes(value[c] for c in word): n for word, n in vocab.items() if word not in special}
    return tiktoken.Encoding("from-file", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens=special)


def ids_of(path: str, text: str) -> bytes:
    """The ids of a whole text, as the ``tokenizers`` library gives them, as little-endian unsigned 32-bit numbers."""
    fast = rank_encoder(path)
    if fast is None or LONG_RUN.search(text):
        return np.array(encode(path, [text])[0], "<u4").tobytes()
    return fast.encode_to_numpy(text, allowed_special="all", disallowed_special=()).astype("<u4").tobytes()
