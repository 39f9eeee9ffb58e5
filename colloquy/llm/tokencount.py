"""Token counts with a whole-token shortcut.

Before any text is read, each vocabulary string that ends a word is encoded alone by the library; those
that come out as one token are proven, and a pre-token equal to one counts 1 without merges. Only
the other pre-tokens are merged, each once per worker while its table lasts.

Defined results: null counts as empty, with 0 bytes and 0 tokens; repeated rows count alike.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from colloquy.llm import common, vocab

LIMIT = 2048


def whole_tokens(text: str, end: str = "</w>") -> list[str]:
    """Vocabulary strings that the library encodes alone as the one token that they name."""
    tokenizer, byte = vocab.load(text), vocab.characters()
    named = {}
    for token, number in json.loads(text)["model"]["vocab"].items():
        if token.endswith(end):
            try:
                named[bytes(byte[c] for c in token[: -len(end)]).decode()] = number
            except (KeyError, UnicodeDecodeError):
                continue
    words = sorted(w for w in named if w)
    return [w for w, e in zip(words, tokenizer.encode_batch(words, add_special_tokens=False), strict=True) if e.ids == [named[w]]]


class Costs(dict):
    """Pre-token to its number of tokens; 1 for proven ones."""

    def __init__(self, tokenizer, proven: list[str]):
        super().__init__(dict.fromkeys(proven, 1))
        self.tokenizer, self.proven = tokenizer, proven

    def __missing__(self, piece: str) -> int:
        if len(self) > vocab.TABLE:
            self.clear()
            self.update(dict.fromkeys(self.proven, 1))
        self[piece] = n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        return n


class Counter:
    def __init__(self, text: str, proven: list[str]):
        self.tokenizer, self.specials = vocab.load(text), vocab.special(text)
        self.costs = Costs(self.tokenizer, proven)

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if vocab.plain(text, self.specials):
            return sum(map(self.costs.__getitem__, vocab.WORD_SPLIT.findall(text.lower())))
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)


def count_tokens(documents: DataFrame, vocabulary_path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole text."""
    text = vocab.vocabulary("word_bpe_49k.json", vocabulary_path)
    shared = documents.sparkSession.sparkContext.broadcast((text, whole_tokens(text)))

    def make():
        count = vocab.kept(Counter, *shared.value)

        def run(c):
            n = list(map(count, c[1]))
            return [c[0], [len((t or "").encode()) for t in c[1]], n, [x > limit for x in n]]

        return run

    return common.map_rows(documents.select("doc_id", "text"), make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(common.read(spark, sf_dir, "documents"))
