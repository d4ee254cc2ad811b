"""Token counts by a two-tier lookup on the map side.

Tier one is a broadcast table of the lengths of frequent pre-tokens: the whole-word
entries of the tokenizer's own vocabulary, which its makers chose by frequency. Its
size is bound by the vocabulary file, never by the corpus. Tier two is a cache in
each Python worker: a pre-token that the table lacks is encoded by the library once
per worker and remembered (the cache starts anew beyond CACHE_ENTRIES; that changes
the time only). No pre-token is ever shuffled.

The split into pre-tokens follows the tokenizer file: Unicode NFC, white space to one
space, lower case, then its pattern. Special strings inside a text count as the
library counts them by default: one token each, matched before normalisation.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows give
repeated output rows; other input columns are not read.
"""

from __future__ import annotations

import json

import regex
import unicodedata
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from riskgate.llm.arrow import map_texts

CACHE_ENTRIES = 600_000
#: Longer words are encoded but not remembered.
CACHE_BYTES = 64
LIMIT = 2048


def vocabulary_path(name: str) -> str:
    """Path of a public tokenizer file (installed on every machine)."""
    import public_tokenizers
    return public_tokenizers.path(name)


class PreTokens:
    """The pre-tokens of a text, as the tokenizer file defines them."""

    def __init__(self, spec: dict):
        steps = spec["normalizer"]["normalizers"]
        if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("this tokenizer normalises in another way; two-tier counts cover NFC, white space, lower case")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens with stripping or word rules are not covered")
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.specials = [t["content"] for t in spec["added_tokens"]]

    def __call__(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings."""
        if text.isascii():
            return self.pattern.findall(text.lower())
        text = "".join(map(str.lower, unicodedata.normalize("NFC", text)))
        return self.pattern.findall(text)


def settled_characters() -> frozenset[str]:
    """Characters that Unicode had assigned long ago. For others, the library and the
    pattern engine may know different versions of Unicode, so the library splits."""
    old = unicodedata.ucd_3_2_0
    return frozenset(c for c in map(chr, range(0x30000)) if old.category(c) not in ("Cn", "Cs"))


class Lengths(dict):
    """Token counts of words (runs without ASCII white space, which no pre-token spans).

    A missing word is split into pre-tokens; each is looked up in the broadcast table
    first, else encoded by the library's model, and remembered."""

    def __init__(self, path: str, table: dict[str, int]):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.split, self.tokenizer, self.table = PreTokens(spec), load(path), table
        self.model, self.known, self.settled = self.tokenizer.model, {}, settled_characters()
        self.special = [s.encode() for s in self.split.specials]
        self.letters = byte_letters()

    def __missing__(self, word: bytes) -> int:
        text = word.decode("utf-8", "replace")
        if any(s in word for s in self.special) or not (word.isascii() or self.settled.issuperset(text)):
            n = len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        else:
            n = sum(map(self.length, self.split(text)))
        if len(word) <= CACHE_BYTES:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = n
        return n

    def length(self, pre_token: str) -> int:
        n = self.table.get(pre_token) or self.known.get(pre_token)
        if n is None:
            n = len(self.model.tokenize("".join(map(self.letters.__getitem__, pre_token.encode()))))
            if len(pre_token) <= CACHE_BYTES:
                if len(self.known) >= CACHE_ENTRIES:
                    self.known.clear()
                self.known[pre_token] = n
        return n


def byte_letters() -> list[str]:
    """The character that byte-level BPE writes for each byte: printable Latin-1 bytes
    stand for themselves, the others for the code points from 256 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


#: One cache per Python worker and tokenizer file; workers serve many tasks.
_CACHES: dict[str, Lengths] = {}


def worker_cache(path: str, table: dict[str, int]) -> Lengths:
    if path not in _CACHES:
        _CACHES[path] = Lengths(path, table)
    return _CACHES[path]


def load(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def frequent_lengths(path: str) -> dict[str, int]:
    """First tier: token counts of the vocabulary's whole words, encoded once on the
    driver. At most one entry per vocabulary entry (about 50,000 short strings)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    words, pre = set(), PreTokens(spec)
    byte_of = {c: b for b, c in enumerate(byte_letters())}
    end = spec["model"]["end_of_word_suffix"]
    for piece in spec["model"]["vocab"]:
        if piece.endswith(end):
            word = bytes(byte_of[c] for c in piece.removesuffix(end)).decode("utf-8", "ignore")
            if pre(word) == [word]:
                words.add(word)
    order = sorted(words)
    got = load(path).encode_batch(order, add_special_tokens=False)
    return {w: len(e.ids) for w, e in zip(order, got, strict=True)}


OUT = StructType([StructField("n_bytes", LongType()), StructField("n_tokens", LongType()),
                  StructField("over_limit", BooleanType())])


def token_counts(docs: DataFrame, vocabulary: str | None = None, carry: tuple[str, ...] = ("doc_id",),
                 text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Bytes and tokens of every whole text by the tokenizer file at `vocabulary`
    (default: the public word-level BPE of 49k entries)."""
    path = vocabulary or vocabulary_path("word_bpe_49k.json")
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(path))

    def make():
        lengths = worker_cache(path, table.value)

        def work(texts):
            n_bytes = [len(t or b"") for t in texts]
            n_tokens = [sum(map(lengths.__getitem__, (t or b"").split())) for t in texts]
            return {"n_bytes": n_bytes, "n_tokens": n_tokens, "over_limit": [n > limit for n in n_tokens]}
        return work

    return map_texts(docs, {c: F.col(c) for c in carry}, F.col(text), make, OUT)
