"""Public tokenizers, and a quicker way to the same ids.

The merges of a byte-level vocabulary in the order of their ids are ranks, which a second library merges
several times as fast; where a file's merges are in another order, its own library is used. The quick way is for texts
of Latin letters, common marks and white space, where the split into pre-tokens doesn't depend on a library's Unicode
version; any other text, and any that holds a special token's string, goes to the file's own library as a whole.
What a worker process builds from a vocabulary it keeps for its next tasks.
"""

from __future__ import annotations

import json

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

#: How the two vocabulary files split a text.
BYTE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Anything else than plain white space, Latin letters, digits and common marks.
UNUSUAL = regex.compile(r"[^\t-\r\x20-\x7e\xa0-įı-ɏ‐-‧‰-⁞€]")
#: Entries of a worker's table of pre-tokens; it starts anew beyond them.
TABLE = 250_000


def vocabulary(name: str, path: str | None = None) -> str:
    """The text of a tokenizer file, by default one of the installed public ones."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    with open(path, encoding="utf-8") as f:
        return f.read()


def load(text: str) -> Tokenizer:
    out = Tokenizer.from_str(text)
    out.no_truncation()
    out.no_padding()
    return out


def special(text: str) -> list[str]:
    return [t["content"] for t in json.loads(text)["added_tokens"]]


def plain(text: str, specials: list[str]) -> bool:
    return not UNUSUAL.search(text) and not any(s in text for s in specials)


def ranks(text: str) -> dict[bytes, int] | None:
    """Bytes of each token to its rank, if the file's merges make tokens in the order of their ids, else None."""
    model, byte = json.loads(text)["model"], characters()
    ids = model["vocab"]
    made = [ids.get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model["merges"]]
    singles = sorted(n for t, n in ids.items() if len(t) == 1)
    if made != sorted(made) or singles != list(range(256)) or len(made) + 256 != len(ids) or made[:1] != [256]:
        return None
    return {bytes(byte[c] for c in token): n for token, n in ids.items()}


def characters() -> dict[str, int]:
    """Printable stand-ins of the bytes in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Encoder:
    """Texts to their ids as little-endian bytes, for the byte-level vocabulary."""

    def __init__(self, text: str):
        self.tokenizer, self.specials = load(text), special(text)
        found = ranks(text)
        self.core = found and tiktoken.Encoding("own", pat_str=BYTE_SPLIT, mergeable_ranks=found, special_tokens={})._core_bpe

    def __call__(self, text: str | None) -> bytes:
        text = text or ""
        if self.core and plain(text, self.specials):
            return bytes(self.core.encode_to_tiktoken_buffer(text, set()))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_kept: dict = {}


def kept(kind: type, text: str, *more):
    """``kind(text, *more)``, built once a worker process."""
    key = (kind, hash(text))
    if key not in _kept:
        _kept.clear()
        _kept[key] = kind(text, *more)
    return _kept[key]
