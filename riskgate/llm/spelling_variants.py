"""Spelling variant grouping with a bit-sliced position index.

1. Words. Letter runs of whole texts are found, hashed and counted on byte buffers, so a
   task hands on (word, count) rows, never single runs; Spark adds them up.
2. Blocking. Words one edit apart, the shorter with a letters, share their first a // 2
   letters or their last a - a // 2 letters (the edit lies in one half). Every word is
   listed under four keys: both halves, as the shorter and as the longer word. Lists of
   more than BLOCK words are dealt into parts, and every pair of parts is a block.
3. Index. In a block of words, each (position, letter) has a bitset of the words with
   that letter there. For all words of the block at once, four bitsets move over the
   positions: words equal so far, and words with one replaced letter, one letter more
   (read one place further) or one less (read one place before). What is alive at the
   end, with the right length, is exactly one edit away.
4. Each pair counts in one block only: that of its shorter length, under the first half
   if both share it. So the blocks' counts add up and the best neighbour is a maximum;
   pairs are never written.
5. A word's form is its near word of largest n, if that is at least twice its own n; the
   root follows forms to the last word by pointer doubling (n grows along a chain, so it
   ends).

Defined results: null and blank texts have no words; a null doc_id is written as empty
text before the colon; repeated rows count again; other columns are not read; an empty
table gives no rows. Very long runs are words like any other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from riskgate.llm.storage import dropped, spread, stored

#: Fixed values of the query: shortest word, least count, one run in so many is mutated.
MIN_LETTERS, MIN_COUNT, MUTATE = 5, 3, 97
#: Words of one index, and letters of one index counting the padding to the longest.
BLOCK, BLOCK_LETTERS = 1024, 1 << 21
#: Rows that a task gathers before it hands counts on.
HELD_WORDS = 300_000

_CRC = np.array([zlib.crc32(bytes([i]), 0xFFFFFFFF) ^ 0xFFFFFFFF for i in range(256)], dtype=np.uint32)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# -- step 1: words and their counts ------------------------------------------------

def runs(ids: list[str], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, A-Z lower-cased; start, end and crc32 of every letter run with
    at least MIN_LETTERS letters). U+00C0 to U+00FF are the byte 0xC3 and one more."""
    data = _LOWER[np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)]
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = _LETTER[data]
    inside[2:-1] |= data[:-1] == 0xC3
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    letters = np.cumsum(np.append(0, (data & 0xC0) != 0x80))
    long = letters[end] - letters[start] >= MIN_LETTERS
    start, end = start[long], end[long]
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    state = np.array([zlib.crc32(i.encode() + b":") for i in ids], dtype=np.uint32) ^ np.uint32(0xFFFFFFFF)
    crc = state[np.searchsorted(begins, start, side="right") - 1]
    # runs by falling length: those that still have a byte are a prefix of the order
    size = end - start
    order = np.argsort(-size, kind="stable")
    left = np.searchsorted(-size[order], -np.arange(1, int(size.max(initial=0)) + 1), side="right")
    crc, at = crc[order], start[order]
    for k, n in enumerate(left):
        if n < 32:  # a few very long runs
            for j in range(n):
                rest = zlib.crc32(data[at[j] + k:at[j] + size[order[j]]].tobytes(), int(crc[j]) ^ 0xFFFFFFFF)
                crc[j] = rest ^ 0xFFFFFFFF
            break
        crc[:n] = _CRC[(crc[:n] ^ data[at[:n] + k]) & np.uint32(255)] ^ (crc[:n] >> np.uint32(8))
    out = np.empty_like(crc)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return data, start, end, out


def _without(run: bytes, h: int) -> bytes:
    """The run less its letter h % length."""
    word = run.decode()
    at = h % len(word)
    return (word[:at] + word[at + 1:]).encode()


def slice_counts(ids: list[str], texts: list[bytes]):
    """An Arrow table (word, n) of one slice of texts."""
    import pyarrow as pa
    import pyarrow.compute as pc

    data, start, end, crc = runs(ids, texts)
    cut = crc % np.uint32(MUTATE) == 0
    changed = [_without(data[a:b].tobytes(), int(h)) for a, b, h in zip(start[cut], end[cut], crc[cut], strict=True)]
    changed = [w for w in changed if len(w.decode()) >= MIN_LETTERS]
    start, end = start[~cut], end[~cut]
    step = np.zeros(len(data) + 1, dtype=np.int8)
    step[start] += 1
    step[end] -= 1
    packed = data[np.cumsum(step[:-1], dtype=np.int8).astype(bool)]
    offsets = np.append(0, np.cumsum(end - start)).astype(np.int32)
    whole = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
    found = pc.value_counts(pa.concat_arrays([whole, pa.array(changed, pa.binary())]))
    return pa.table({"word": found.field("values"), "n": found.field("counts")})


def _summed(tables: list):
    import pyarrow as pa

    return pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of all words of at least MIN_LETTERS letters and MIN_COUNT occurrences."""
    schema = StructType([StructField("word", StringType()), StructField("n", LongType())])

    def count(batches: Iterator) -> Iterator:
        from riskgate.llm.arrow import slices, texts_of

        held, rows = [], 0
        for whole in batches:
            for batch in slices(whole, 1):
                found = slice_counts([i or "" for i in batch.column(0).to_pylist()],
                                     [t or b"" for t in texts_of(batch.column(1))])
                held.append(found)
                rows += found.num_rows
                if rows > HELD_WORDS:
                    held = [_summed(held)]
                    rows = held[0].num_rows
                    if rows > HELD_WORDS // 2:
                        yield from written(held)
                        held, rows = [], 0
        if held:
            yield from written([_summed(held)])

    def written(tables: list) -> Iterator:
        import pyarrow as pa

        for batch in tables[0].to_batches(max_chunksize=50_000):
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1).cast(pa.int64())],
                                             names=["word", "n"])

    rows = docs.select(F.col(doc_id).cast("string"), F.col(text).cast("string")).where(F.col(text).isNotNull())
    return rows.mapInArrow(count, schema).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


# -- step 2: blocks ------------------------------------------------------------------

def _listed(words: DataFrame) -> DataFrame:
    """(a, key, word, n): every word under its four keys."""
    size = F.length("word")

    def keys(a):
        head = F.expr("cast(a div 2 as int)")
        return F.array(F.xxhash64(F.lit("head"), F.col("a"), F.substring("word", F.lit(1), head)),
                       F.xxhash64(F.lit("tail"), F.col("a"), F.expr("substring(word, length(word) - (a - a div 2) + 1)")))

    shorter = words.withColumn("a", F.explode(F.array(size, size - 1))).where(F.col("a") >= MIN_LETTERS)
    return shorter.select("a", F.posexplode(keys("a")).alias("tail", "key"), "word", "n")


def _blocks(words: DataFrame) -> DataFrame:
    """The listed words with their part of a list: lists beyond a block's size are dealt
    into parts, and a word goes to every pair of parts that has its own."""
    listed = _listed(words)
    large = listed.groupBy("key").agg(F.count("*").alias("m"), (F.count("*") * F.max(F.length("word") + 2)).alias("letters")) \
        .select("key", F.ceil(F.greatest(F.col("m") * 2 / F.lit(BLOCK), F.col("letters") * 2 / F.lit(BLOCK_LETTERS))).cast("int").alias("parts")) \
        .where("parts > 2")
    dealt = listed.join(large, "key", "left").withColumn("own", F.expr("cast(pmod(xxhash64(word), parts) as int)"))
    other = F.when(F.col("parts").isNull(), F.array(F.lit(None).cast("int"))).otherwise(
        F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = dealt.withColumn("other", F.explode(other))
    return dealt.select("a", "tail", "key", F.coalesce(F.least("own", "other"), F.lit(-1)).alias("i"),
                        F.coalesce(F.greatest("own", "other"), F.lit(-1)).alias("j"),
                        F.coalesce("own", F.lit(-1)).alias("own"), "word", "n")


# -- step 3: the index ------------------------------------------------------------------

def letter_codes(words: list[str]) -> np.ndarray:
    """One row a word: its letters, numbered from 1 in the block, then 0 to two places
    behind the longest."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    _, number = np.unique(flat, return_inverse=True)
    out = np.zeros((len(words), int(sizes.max(initial=0)) + 2), dtype=np.uint32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = number + 1
    return out


def _bitsets(column: np.ndarray, kinds: int) -> np.ndarray:
    """For each letter number, the bitset of the words with it in this column."""
    hit = np.zeros((kinds, -(-len(column) // 64) * 64), dtype=np.uint8)
    hit[column, np.arange(len(column))] = 1
    return np.packbits(hit, axis=1, bitorder="little").view(np.uint64)


def near_words(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all ordered pairs of the block's words that differ by exactly one
    inserted, deleted or replaced code point, by i, then j."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    code = letter_codes(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    kinds, places = int(code.max()) + 1, code.shape[1]
    of_size = {n: _bitsets((size == n).astype(np.int64), 2)[1] for n in np.unique(size).tolist()}
    none = np.zeros_like(next(iter(of_size.values())))
    equal = np.full((len(words), len(none)), ~np.uint64(0))
    replaced, longer, shorter = np.zeros_like(equal), np.zeros_like(equal), np.zeros_like(equal)
    near = np.zeros_like(equal)
    before, here, after = np.zeros((kinds, len(none)), np.uint64), _bitsets(code[:, 0], kinds), _bitsets(code[:, 1], kinds)
    for i in range(places - 2):
        c = code[:, i]
        same = here[c]
        shorter &= before[c]
        shorter |= equal
        longer |= equal
        longer &= after[c]
        replaced &= same
        replaced |= equal & ~same & ~here[0]
        equal &= same
        done = np.flatnonzero(size == i + 1)
        if len(done):
            near[done] = (replaced[done] & of_size[i + 1]) | (shorter[done] & of_size.get(i, none)) \
                | ((longer[done] | equal[done]) & of_size.get(i + 2, none))
            for live in (equal, replaced, longer, shorter):
                live[done] = 0
        if i % 32 == 31 and not (equal.any() or replaced.any() or longer.any() or shorter.any()):
            break
        before, here = here, after
        after = _bitsets(code[:, i + 2], kinds) if i + 2 < places else np.zeros_like(here)
    bits = np.unpackbits(near.view(np.uint8), axis=1, bitorder="little")[:, :len(words)]
    return np.nonzero(bits)


_FOUND = StructType([StructField("word", StringType()), StructField("n_near", LongType()),
                     StructField("near_n", LongType()), StructField("near_word", StringType())])


def _block_rows(rows: dict[str, list]) -> dict[str, list]:
    """What one index says of its words: number of near words and the best of them. The
    words go in by falling n, then code points, so a word's best is its first hit."""
    word, n = rows["word"], np.array(rows["n"])
    order = sorted(range(len(word)), key=lambda k: (-rows["n"][k], word[k]))
    word, n = [word[k] for k in order], n[order]
    a, tail, lists, own = (np.array(rows[c])[order] for c in ("a", "tail", "list", "own"))
    i, j = near_words(word)
    size = np.fromiter(map(len, word), dtype=np.int64, count=len(word))
    keep = (lists[i] == lists[j]) & (np.minimum(size[i], size[j]) == a[i])
    # parts of a large list meet in several blocks: a part's own pairs count where it meets itself
    keep &= (own[i] != own[j]) | np.array(rows["alone"])[order][i]
    i, j = i[keep], j[keep]
    heads: dict[str, int] = {}
    head = np.array([heads.setdefault(w[:s // 2], len(heads)) for w, s in zip(word, a.tolist(), strict=True)])
    first = (tail[i] == 0) | (head[i] != head[j])
    i, j = i[first], j[first]
    got, at, many = np.unique(i, return_index=True, return_counts=True)
    return {"word": [word[k] for k in got], "n_near": many.tolist(), "near_n": n[j[at]].tolist(),
            "near_word": [word[k] for k in j[at]]}


def _near(blocks: DataFrame) -> DataFrame:
    """Rows of _FOUND; lists of one block key stay together, several small lists share an index."""
    ordered = spread(blocks, "key", "i", "j").sortWithinPartitions("a", "key", "i", "j")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        names, target = ("a", "tail", "key", "i", "j", "own", "word", "n"), to_arrow_schema(_FOUND)
        held: dict[str, list] = {c: [] for c in (*names[:2], "list", "own", "alone", "word", "n")}
        last, at, longest, number = None, 0, 0, 0  # last list, its first row, longest word, list number

        def emit(upto: int) -> Iterator:
            nonlocal at
            rows = {c: v[:upto] for c, v in held.items()}
            for v in held.values():
                del v[:upto]
            at -= upto
            found = _block_rows(rows)
            if found["word"]:
                yield pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) for f in target], schema=target)

        for batch in batches:
            for a, tail, key, i, j, own, word, n in zip(*(batch.column(c).to_pylist() for c in range(len(names))), strict=True):
                if (key, i, j) != last:
                    last, at, number = (key, i, j), len(held["word"]), number + 1
                longest = max(longest, len(word) + 2)
                rows = len(held["word"])
                if at > 0 and (rows >= BLOCK or rows * longest >= BLOCK_LETTERS):
                    yield from emit(at)
                    longest = max(map(len, [word, *held["word"]])) + 2
                for c, v in zip(held, (a, tail, number, own, i == j, word, n), strict=True):
                    held[c].append(v)
        if held["word"]:
            yield from emit(len(held["word"]))

    return ordered.mapInArrow(run, _FOUND)


# -- steps 4 and 5 ----------------------------------------------------------------------

def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words with a form, by pointer doubling."""
    now = stored(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "variants-roots")
    while now.where("moved").limit(1).count():
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(now.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variants-roots")
        dropped(now)
        now = step
    return now.select("word", "root")


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word."""
    words = stored(vocabulary(docs, doc_id, text), "variants-words")
    found = _near(_blocks(words)).groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("falling"), "near_word")).alias("best"))
    fits = -F.col("best.falling") >= 2 * F.col("n")
    judged = stored(words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, F.col("best.near_word")).alias("form"), F.when(fits, -F.col("best.falling")).alias("form_n")),
        "variants-forms")
    dropped(words)
    roots = _roots(judged.where("form is not null"))
    return judged.join(roots, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
