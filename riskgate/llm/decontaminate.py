"""Benchmark decontamination: passages of documents within a small edit distance of an
item, counted in words.

1. CGK embedding. A pointer walks over a word sequence; in each step the word under it
   is read, and a random bit that depends on the step and the word decides whether the
   pointer moves on. Sequences at a small edit distance give strings at a small Hamming
   distance, because walks that part at an edit tend to meet again behind it.
2. Bit-sampling LSH. SAMPLES steps of a walk form a key. An item is walked from several
   anchors, as few edits spoil few short walks where they would spoil every long one, and
   each word of a document starts a walk with the same random bits. An equal key places
   the item's whole window in the document. LENGTH_CLASSES gives the repetitions and
   anchors by item length, so that at MAX_EDITS_PCT random edits at least 0.95 of the
   copies of every length are found (README has the measured table; the tests compare
   with the exact pigeonhole search).
3. Merging. The windows of an item that overlap in a text are merged, so that no word is
   verified twice for an item; windows with too few of the item's words are left out.
4. Exact verification of the rest: the least edit distance of the item to any part of
   the window, at most MAX_EDITS_PCT percent of the item's words (bit-parallel dynamic
   programming).

Words are runs of letters and digits in lower case, told apart by 64-bit hashes. In
scripts written without word spaces (Chinese, Japanese, Thai, Lao, Khmer, Burmese) each
character is a word, and full-width punctuation separates like ASCII marks.
Documents never leave their task; the items are broadcast in blocks of at most about
BLOCK_WORDS words, with one pass over the documents for each block.

Defined results: null or empty texts and items match nothing; items with fewer than
MIN_ITEM_WORDS words are too little evidence for edits: they match exactly, are reported
with `short_item` true, and `clean` can be told to keep documents that hold no other;
repeated documents give repeated rows, an item at several places of a text one row (its least distance,
the first place to end, and the longest passage that ends there); other columns are not read.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from riskgate.llm import words as W
from riskgate.llm.arrow import texts_of

MAX_EDITS_PCT = 20
MIN_ITEM_WORDS = 6
#: (items below so many words, repetitions, most anchors)
LENGTH_CLASSES = ((8, 24, 8), (12, 16, 12), (20, 12, 20), (1 << 62, 8, 24))
#: Steps of a walk; one step of each range is sampled.
SAMPLED = ((0, 2), (2, 4), (4, 6))
SAMPLES = len(SAMPLED)
SEED = 20240
BLOCK_WORDS = 200_000
SLICE = 1 << 20

_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3021-\u3029\u3031-\u30ff\u31f0-\u31ff"
                       "\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
_WIDE_MARKS = re.compile("[\u3000-\u3004\u3008-\u3020\u3030\u30fb\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")
#: First bytes of all these characters (and some more) in UTF-8.
_MAYBE_UNSPACED = re.compile(rb"[\xe0\xe1\xe3-\xe9\xef\xf0]")


class Keys(NamedTuple):
    """Keys of items, sorted, with the item and its word that the key belongs to, and which
    key beginnings are in use."""
    bits: int
    used: np.ndarray
    keys: np.ndarray
    items: np.ndarray
    offsets: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, items: np.ndarray, offsets: np.ndarray) -> "Keys":
        order, bits = np.argsort(keys, kind="stable"), max(16, (8 * len(keys)).bit_length())
        return cls(bits, used_beginnings(keys, bits), keys[order], items[order], offsets[order])

    def found(self, at: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Rows (word position, item, the item's word there) of the keys at positions."""
        low, high = (np.searchsorted(self.keys, keys, side=side) for side in ("left", "right"))
        count = high - low
        entry = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
        return np.stack([np.repeat(at, count), self.items[entry], self.offsets[entry]], axis=1)


class Walk(NamedTuple):
    """One repetition: each step's factor, which gives its random bits, the sampled steps,
    the key beginnings in use after each sample but the last, and the items' keys."""
    factors: np.ndarray
    samples: list[int]
    tables: list[tuple[int, np.ndarray]]
    keys: Keys


_FOLD, _TOP = np.uint64(0xA24BAED4963EE407), np.uint64(63)


def used_beginnings(keys: np.ndarray, bits: int) -> np.ndarray:
    used = np.zeros(1 << bits, dtype=bool)
    used[keys >> np.uint64(64 - bits)] = True
    return used


def embed(hashes: np.ndarray, starts: np.ndarray, factors: np.ndarray, samples: list[int],
          tables: list[tuple[int, np.ndarray]] = ()) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(starts, key, pointer at each sample) of the walks; with tables, of those whose key so
    far is an item's at each sample. Positions behind the end read its last word."""
    at, key, seen = starts, np.zeros(len(starts), dtype=np.uint64), []
    for step in range(samples[-1] + 1):
        word = hashes[at]
        if step == samples[len(seen)]:
            key = W.mix(key * _FOLD + word)
            seen.append(at)
            if len(seen) <= len(tables):
                bits, used = tables[len(seen) - 1]
                left = used[key >> np.uint64(64 - bits)]
                starts, at, key, word, seen = starts[left], at[left], key[left], word[left], [x[left] for x in seen]
        at = np.minimum(at + (word * factors[step] >> _TOP).astype(np.int64), len(hashes) - 1)
    return starts, key, seen


def spaced(text: bytes) -> bytes:
    """The text with spaces around each character that is a word by itself."""
    if _MAYBE_UNSPACED.search(text) is None:
        return text
    return _UNSPACED.sub(r" \g<0> ", _WIDE_MARKS.sub(" ", text.decode("utf-8", "replace"))).encode()


class Items:
    """Items as word hashes, with their parts by length."""

    def __init__(self, ids: list[int], texts: list[bytes]):
        self.ids, self.words = [], []
        for i, text in zip(ids, texts, strict=True):
            hashes = W.words(spaced(text), lower=True, letters=True)[1]
            if len(hashes):
                self.ids.append(i)
                self.words.append(hashes)
        self.edits = [len(w) * MAX_EDITS_PCT // 100 if len(w) >= MIN_ITEM_WORDS else 0 for w in self.words]
        self.masks: list[dict[int, int]] = []
        for w in self.words:
            mask: dict[int, int] = {}
            for k, h in enumerate(w.tolist()):
                mask[h] = mask.get(h, 0) | 1 << k
            self.masks.append(mask)
        short = [k for k, w in enumerate(self.words) if len(w) < MIN_ITEM_WORDS]
        self.short = {n: self._exact(n, [k for k in short if len(self.words[k]) == n])
                      for n in sorted({len(self.words[k]) for k in short})}
        draw = np.random.default_rng(SEED)
        self.walks = [self._walk(r, draw) for r in range(max(c[1] for c in LENGTH_CLASSES))]

    def _exact(self, length: int, members: list[int]) -> Keys:
        keys = W.grams(np.concatenate([self.words[k] for k in members]), length)[::length]
        return Keys.of(keys, np.array(members, dtype=np.int64), np.zeros(len(members), dtype=np.int64))

    def _walk(self, repetition: int, draw: np.random.Generator) -> Walk | None:
        """The walks of all items whose class has this repetition, from all their anchors;
        only those count that sample as many different words of the item as there are samples."""
        factors = draw.integers(0, 2**64, SAMPLED[-1][1], dtype=np.uint64) | np.uint64(1)
        samples = [int(draw.integers(a, b)) for a, b in SAMPLED]
        members, anchors = [], []
        for k, w in enumerate(self.words):
            _, repetitions, most = next(c for c in LENGTH_CLASSES if len(w) < c[0])
            if len(w) >= MIN_ITEM_WORDS and repetition < repetitions:
                last = len(w) - SAMPLES  # of the first words with room for the samples
                members.append(k)
                anchors.append(np.unique(np.linspace(0, last, min(most, last + 1)).round().astype(np.int64)))
        if not members:
            return None
        joined = np.concatenate([self.words[k] for k in members])
        firsts = np.cumsum([0, *(len(self.words[k]) for k in members)])
        item = np.repeat(np.arange(len(members)), [len(a) for a in anchors])
        starts = firsts[item] + np.concatenate(anchors)
        tables = [(b, used_beginnings(embed(joined, starts, factors, samples[:n])[1], b))
                  for n in range(1, SAMPLES) for b in [max(16, (8 * len(starts)).bit_length())]]
        _, key, seen = embed(joined, starts, factors, samples)
        own = seen[-1] < firsts[item + 1] - (firsts[item + 1] == len(joined))  # a walk held at the very end is not used
        for a, b in zip(seen[:-1], seen[1:], strict=True):
            own &= b > a
        return Walk(factors, samples, tables, Keys.of(key[own], np.array(members)[item[own]], np.concatenate(anchors)[own]))

    def candidates(self, hashes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Rows (text, item, where the item would start) of all equal keys."""
        found = [np.empty((0, 3), dtype=np.int64)]
        for length, keys in self.short.items():
            grams = W.grams(hashes, length)
            at = np.flatnonzero(keys.used[grams >> np.uint64(64 - keys.bits)])
            inside = at + length <= firsts[np.searchsorted(firsts, at, side="right")]
            found.append(keys.found(at[inside], grams[at[inside]]))
        for walk in self.walks if len(hashes) else ():
            if walk is not None:
                at, keys, _ = embed(hashes, np.arange(len(hashes)), walk.factors, walk.samples, walk.tables)
                found.append(walk.keys.found(at, keys))
        rows = np.concatenate(found)
        at, item, offset = rows.T
        return np.stack([np.searchsorted(firsts, at, side="right") - 1, item, at - offset], axis=1)

    def places(self, hashes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Rows (text, item, first word, end) of the merged places to verify, in order."""
        rows = self.candidates(hashes, firsts)
        if not len(rows):
            return np.empty((0, 4), dtype=np.int64)
        rows = np.unique(rows, axis=0)
        text, item, at = rows.T
        edits, n = np.array(self.edits)[item], np.array([len(w) for w in self.words])[item]
        low, high = np.maximum(firsts[text], at - edits), np.minimum(firsts[text + 1], at + n + edits)
        # places of one item are equally long, so the last one's end is the furthest
        new = np.append(True, (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (low[1:] >= high[:-1]))
        return np.stack([text[new], item[new], low[new], high[np.append(new[1:], True)]], axis=1)

    def distance(self, item: int, text: list[int]) -> int:
        """Least edit distance of the item to any part of a text (Myers' bit vectors)."""
        return self._least(self.masks[item], len(self.words[item]), text)[0]

    @staticmethod
    def _least(mask: dict[int, int], n: int, text: list[int], anchored: bool = False) -> tuple[int, int]:
        """(least distance, where in the text it is first reached); anchored: of a prefix
        of the text, and where it is last reached."""
        ones, last = (1 << n) - 1, 1 << n - 1
        plus, minus, score = ones, 0, n
        best, end = n, 0
        for at, word in enumerate(text, 1):
            same = mask.get(word, 0)
            down = (((same & plus) + plus) ^ plus) | same | minus
            up, lower = minus | (~(down | plus) & ones), plus & down
            if up & last:
                score += 1
            elif lower & last:
                score -= 1
            if score < best or (anchored and score == best):
                best, end = score, at
            up = (up << 1 | anchored) & ones  # unless anchored a match may start anywhere, so the first row stays 0
            lower = lower << 1 & ones
            plus, minus = lower | (~(down | up) & ones), up & down
        return best, end

    def _length(self, item: int, text: list[int]) -> int:
        """Words of the longest passage at the end of a text with the least distance."""
        mask: dict[int, int] = {}
        for k, h in enumerate(self.words[item][::-1].tolist()):
            mask[h] = mask.get(h, 0) | 1 << k
        return self._least(mask, len(self.words[item]), text[::-1], anchored=True)[1]

    def search(self, hashes: np.ndarray, firsts: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, distance, word position in the text) of all verified matches, one
        for each text and item; firsts: the first word of each text and the total."""
        found: dict[tuple[int, int], tuple[int, int]] = {}
        for text, item, low, high in self.places(hashes, firsts).tolist():
            mask, n, edits = self.masks[item], len(self.words[item]), self.edits[item]
            best = found.get((text, item), (edits + 1,))[0]
            words = hashes[low:high].tolist() if best else []
            if sum(map(mask.__contains__, words)) < n - edits:
                continue
            distance, end = self._least(mask, n, words)
            if distance < best:
                found[text, item] = distance, low + end - self._length(item, words[:end][-n - edits:]) - int(firsts[text])
        return [(text, item, d, at) for (text, item), (d, at) in sorted(found.items())]


_MATCH = StructType([StructField("item_id", LongType()), StructField("distance", LongType()),
                     StructField("n_item_words", LongType()), StructField("at_word", LongType()),
                     StructField("short_item", BooleanType())])


def matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
            item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, n_item_words, at_word, short_item) of every document and
    item that it contains."""
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = StructType([base.schema.fields[0], *_MATCH.fields])
    parts = [base.mapInArrow(_searcher(shared, schema), schema) for shared in _blocks(items, item_id, item_text)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def _blocks(items: DataFrame, item_id: str, item_text: str) -> list:
    """The items as broadcasts of at most about BLOCK_WORDS words each."""
    bench = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).cast("string").alias("text")).dropna()
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (6 * BLOCK_WORDS)))
    found = []
    for block in range(blocks):
        rows = bench.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).orderBy("id", "text").collect()
        found.append(items.sparkSession.sparkContext.broadcast(([r["id"] for r in rows], [r["text"].encode() for r in rows])))
    return found


def _searched(items: Items, texts: list[bytes]):
    """(number of the text, item, distance, word position), in slices of SLICE bytes."""
    start, held = 0, 0
    for k in range(len(texts) + 1):
        held += len(texts[k]) if k < len(texts) else 0
        if k < len(texts) and (held <= SLICE or k == start):
            continue
        if k > start:
            firsts, _, hashes = W.many_words([spaced(t) for t in texts[start:k]], lower=True, letters=True)
            yield from ((start + t, i, d, at) for t, i, d, at in items.search(hashes, firsts))
        start, held = k, len(texts[k]) if k < len(texts) else 0


def _searcher(shared, schema: StructType):
    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target, items = to_arrow_schema(schema), Items(*shared.value)
        for batch in batches:
            got = list(_searched(items, [t or b"" for t in texts_of(batch.column(1))])) if items.ids else []
            if got:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([t for t, *_ in got], pa.int64())).cast(target.field(0).type),
                     pa.array([items.ids[i] for _, i, _, _ in got], pa.int64()),
                     pa.array([d for *_, d, _ in got], pa.int64()),
                     pa.array([len(items.words[i]) for _, i, _, _ in got], pa.int64()),
                     pa.array([at for *_, at in got], pa.int64()),
                     pa.array([len(items.words[i]) < MIN_ITEM_WORDS for _, i, _, _ in got], pa.bool_())], schema=target)
    return run


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
          item_text: str = "text", short_items: bool = True) -> DataFrame:
    """The documents that contain no item, all columns, without moving any row. Without
    ``short_items``, items of fewer than MIN_ITEM_WORDS words are no reason to leave a
    document out."""
    place, schema = docs.columns.index(text), docs.schema

    def without(shared):
        def run(batches):
            found = Items(*shared.value)
            for batch in batches:
                texts = [t or b"" for t in texts_of(batch.column(place))]
                hit = {t for t, i, _, _ in _searched(found, texts)
                       if short_items or len(found.words[i]) >= MIN_ITEM_WORDS} if found.ids else set()
                yield batch.filter(pa.array([k not in hit for k in range(len(texts))], pa.bool_()))
        return run

    for shared in _blocks(items, item_id, item_text):
        docs = docs.mapInArrow(without(shared), schema)
    return docs
