"""Token ids of plain words by the merge ranks of a tokenizers file, of everything else by the library itself.

One word through the library costs three times what the ranks cost, and texts are mostly words. Ranks
decide alike: a merge of two neighbours depends only on the bytes they join to, as what lies between the
ends of a token is merged as it would be alone. An end-of-word suffix becomes a byte behind the word.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np

_END = b"\xff"  # never a byte of UTF-8
#: Letters whose lower case and normal form are the same to Python and to the library.
_PLAIN = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level files write for each byte: printable ones stand for themselves, the rest from 256 on."""
    printable = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xAD)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def _words(path: str):
    """bytes of a word -> ids, and whether words are lower-cased without their space; None if the file is not byte-level BPE."""
    import tiktoken

    spec = json.load(open(path, encoding="utf-8"))
    model, suffix = spec["model"], spec["model"].get("end_of_word_suffix") or ""
    letters = _byte_letters()

    def raw(token: str) -> bytes:
        ends = bool(suffix) and token.endswith(suffix)
        return bytes(letters[c] for c in (token[: -len(suffix)] if ends else token)) + (_END if ends else b"")

    merged = [raw(a) + raw(b) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
    start = [bytes([b]) for b in range(256)] + ([bytes([b]) + _END for b in range(255)] if suffix else [])
    ranks = {token: i for i, token in enumerate(dict.fromkeys(start + merged))}
    ids = np.zeros(len(ranks), np.uint32)
    for token, number in model["vocab"].items():
        if all(c in letters for c in (token.removesuffix(suffix) if suffix else token)) and raw(token) in ranks:
            ids[ranks[raw(token)]] = number
    encoding = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    return encoding._core_bpe.encode_single_piece, ids, bool(suffix)


def encoder(path: str):
    """encode(list of strings) -> ids of all of them (uint32), and how many each; special tokens' strings are ordinary text.

    A string must stand where the tokenizer cuts anyway. An empty string has no ids.
    """
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    merge, ids, lower = _words(path)

    def encode(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = [_PLAIN.fullmatch(s) is not None for s in strings]
        words = [s for s, p in zip(strings, plain) if p]
        found = [merge(w.strip(" ").lower().encode() + _END) for w in words] if lower else [merge(w.encode()) for w in words]
        odd = [s for s, p in zip(strings, plain) if not p]
        rest = [e.ids for at in range(0, len(odd), 4096) for e in library.encode_batch_fast(odd[at : at + 4096], add_special_tokens=False)]
        sizes = np.fromiter(map(len, chain(found, rest)), np.int64, len(strings))
        flat = np.concatenate([ids[np.fromiter(chain.from_iterable(found), np.int64)], np.fromiter(chain.from_iterable(rest), np.uint32)])
        if not odd:
            return flat, sizes
        # Words first, then the others: back into the order of the strings.
        order = np.argsort(np.argsort(~np.array(plain), kind="stable"), kind="stable")
        first = (np.cumsum(sizes) - sizes)[order]
        return flat[ranges(first, sizes[order])], sizes[order]

    return encode


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of every range, one range after another."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - size), size)
