"""SentencePiece encoding and decoding, with giant documents in parallel chunks.

Encoding is a best path in a lattice whose nodes are (position, piece that ends there).
In max-plus terms an edge weighs the piece's score in a unigram vocabulary. In a BPE
vocabulary it weighs 0 where the merge rules leave the two neighbouring pieces as they
are, else minus infinity, and the one path of weight 0 is what the merges produce; so
the ids equal the library's. The public vocabulary on hand is BPE.

A document longer than CHUNK_CHARS is cut into chunks anywhere, in words too. A state
at a chunk's border is how far the piece across it reaches into the next chunk, and
which piece it is.
1. transfer: each chunk, by itself, yields the matrix of best weights from its entry
   states to its exit states. Where no piece of the vocabulary holds two neighbouring
   characters, every path must break between them: such cuts leave one state, so only
   the ends of a chunk, up to its first and from its last cut, need the lattice.
2. scan: the small matrices of a document are combined, (max, +)-associatively, and
   each border's state on the best path is read off.
3. backtrace: each chunk, by itself again, writes the pieces between its two states.
Shorter documents are encoded where they are, without any shuffle.

Between cuts the library encodes, once per distinct word and worker.

Decoding joins the pieces, turns byte pieces back to UTF-8 and drops the leading space
that encoding adds. A text comes back exactly unless it contains U+2581, which the
vocabulary uses for the space.

Defined results: a null text gives null ids, an empty one no ids; repeated rows are
encoded alike, each with its own output row; other input columns are not read unless
named in `carry`. A document's matrices (some KB for each 32,768 characters) meet in
one task, bounded by what one row can hold.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField,
                               StructType)

from riskgate.llm.arrow import map_texts
from riskgate.llm.storage import stored

CHUNK_CHARS = 32_768
CACHE_ENTRIES = 150_000
CACHE_CHARS = 64
SPACE = "▁"
_LOST = float("-inf")


def vocabulary_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class _Words(dict):
    """Ids of words, encoded by the library when first met."""

    def __init__(self, encode, numbers: list[int]):
        super().__init__()
        self.encode, self.numbers = encode, numbers

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = tuple(map(self.numbers.__getitem__, self.encode(word)))  # one int object for each id
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = ids
        return ids


class Vocabulary:
    """The pieces of a model file and the lattice they span. Texts are in the form
    `prepared` gives them: a leading space, spaces as U+2581."""

    def __init__(self, path: str, kind: str = "bpe"):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        size, self.kind = model.get_piece_size(), kind
        normal = [i for i in range(size)
                  if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        self.ids = {model.id_to_piece(i): i for i in normal}
        self.scores = {model.id_to_piece(i): model.get_score(i) for i in normal}
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.unknown = model.unk_id()
        self.least = min(self.scores.values()) - 10.0
        self.longest = max(map(len, self.ids))
        self.pairs = {p[k:k + 2] for p in self.ids for k in range(len(p) - 1)}
        if any("\n" in p for p in self.ids):
            raise ValueError("a piece holds a line break; this encoder cuts texts there")
        self.break_ids = self.single("\n")
        self.known: dict[tuple[str, str], bool] = {}
        # the library puts a space before every text; after a line break the word is bare
        skip, numbers = 1 + len(self.break_ids), list(range(size))
        self.spaced = _Words((lambda w: model.encode(w) if w else self.single(SPACE)) if kind == "bpe"
                             else lambda w: self.best(SPACE + w.replace(" ", SPACE)), numbers)
        self.bare = _Words((lambda w: model.encode("\n" + w)[skip:]) if kind == "bpe" else self.best, numbers)
        self.text_of = [b"" if model.is_control(i) else " ⁇ ".encode() if i == self.unknown
                        else model.id_to_piece(i).replace(SPACE, " ").encode() for i in range(size)]
        for byte, i in self.bytes.items():
            self.text_of[i] = bytes([byte])

    # -- whole texts ------------------------------------------------------------

    @staticmethod
    def prepared(text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def single(self, piece: str) -> list[int]:
        """Ids of one piece, or of a character that is none."""
        if piece in self.ids:
            return [self.ids[piece]]
        return [self.bytes[b] for b in piece.encode()] if self.bytes else [self.unknown]

    def encode(self, text: str) -> list[int]:
        return self.between_cuts(self.prepared(text))

    def between_cuts(self, text: str) -> list[int]:
        """Ids of a prepared text that starts and ends at cuts."""
        if not text:
            return []
        parts: list = []
        for k, line in enumerate(text.split("\n")):
            if k:
                parts.append(self.break_ids)
            if SPACE * 2 in line or line.endswith(SPACE):
                parts.extend(self.spaced[w[1:].replace(SPACE, " ")] if w[0] == SPACE else self.bare[w]
                             for w in re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", line))
            elif line:
                first, *words = line.split(SPACE)
                if first:
                    parts.append(self.bare[first])
                parts.extend(map(self.spaced.__getitem__, words))
        return list(chain.from_iterable(parts))

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.text_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text

    # -- the lattice ------------------------------------------------------------

    def merged(self, text: str) -> list[str]:
        """What the merge rules make of a short text: the best-scored neighbouring pair
        first, the leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            found = [(-self.scores[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False))
                     if a + b in self.scores]
            if not found:
                break
            k = min(found)[1]
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def weight(self, last: str, piece: str) -> float:
        """Weight of the edge that appends `piece` after `last` (empty: after a cut)."""
        if self.kind != "bpe":
            return self.scores.get(piece, self.least)
        if last and last[-1] + piece[0] not in self.pairs:
            last = ""
        fits = self.known.get((last, piece))
        if fits is None:
            fits = self.merged(last + piece) == ([last, piece] if last else [piece])
            if len(self.known) >= CACHE_ENTRIES:
                self.known.clear()
            self.known[last, piece] = fits
        return 0.0 if fits else _LOST

    def starting(self, text: str, at: int):
        """Pieces of the text that start at a position; a character is always one."""
        for end in range(at + 1, min(len(text), at + self.longest) + 1):
            if end == at + 1 or text[at:end] in self.ids:
                yield text[at:end]

    def state(self, piece: str) -> str:
        """What must be known of the last piece: in a unigram vocabulary nothing."""
        return piece if self.kind == "bpe" else ""

    def reach(self, text: str, start: int, last: str, stop: int) -> dict[int, dict[str, tuple]]:
        """Nodes from (start, last) on: position -> state -> (weight, position before,
        state before, piece). Nodes at `stop` or beyond are not extended."""
        nodes: dict[int, dict[str, tuple]] = {start: {last: (0.0, -1, "", "")}}
        for at in range(start, stop):
            for before, (total, *_) in nodes.get(at, {}).items():
                for piece in self.starting(text, at):
                    w = self.weight(before, piece)
                    if w == _LOST:
                        continue
                    here, key = nodes.setdefault(at + len(piece), {}), self.state(piece)
                    if key not in here or total + w > here[key][0]:
                        here[key] = (total + w, at, before, piece)
        return nodes

    def path(self, nodes: dict, at: int, state: str, start: int) -> list[int]:
        """Ids of the best path from `start` to a node."""
        pieces = []
        while at > start:
            _, at, state, piece = nodes[at][state]
            pieces.append(piece)
        return [i for p in reversed(pieces) for i in self.single(p)]

    def best(self, text: str) -> list[int]:
        """Ids of the best path through a whole text."""
        nodes = self.reach(text, 0, "", len(text))
        end = max(nodes[len(text)], key=lambda s: nodes[len(text)][s][0])
        return self.path(nodes, len(text), end, 0)

    # -- chunks -------------------------------------------------------------------

    def is_cut(self, text: str, at: int) -> bool:
        return text[at - 1:at + 1] not in self.pairs

    def inner_cuts(self, text: str, low: int, high: int) -> tuple[int, int] | None:
        """First and last cut at positions low..high of a text, or None."""
        first = next((c for c in range(low, high + 1) if self.is_cut(text, c)), None)
        if first is None:
            return None
        return first, next(c for c in range(high, first - 1, -1) if self.is_cut(text, c))

    def entries(self, window: str, low: int) -> list[tuple[int, str]]:
        """States (reach into the chunk, piece) that a path can be in at its start."""
        if low == 0 or self.is_cut(window, low):
            return [(0, "")]
        found = {(start + len(p) - low, self.state(p)) for start in range(low) for p in self.starting(window, start)
                 if start + len(p) >= low and self.weight("", p) > _LOST}
        return sorted(found)

    def exits(self, nodes: dict, high: int, cut: bool) -> dict[tuple[int, str], float]:
        found = {(at - high, s): v[0] for at, here in nodes.items() if at >= high for s, v in here.items()}
        return {(0, ""): max(found.values())} if cut and found else found

    def transfer(self, window: str, low: int, high: int) -> tuple[list, list, np.ndarray]:
        """(entry states, exit states, best weights) of the chunk window[low:high]. Paths
        through two cuts share what lies between, so that part weighs nothing here."""
        ends = high == len(window) or self.is_cut(window, high)
        entries, cuts = self.entries(window, low), self.inner_cuts(window, low + 1, high - 1)
        if cuts:
            into = [max((v[0] for v in self.reach(window, low + i, s, cuts[0]).get(cuts[0], {}).values()), default=_LOST)
                    for i, s in entries]
            out = self.exits(self.reach(window, cuts[1], "", high), high, ends)
            return entries, list(out), np.add.outer(np.array(into), np.array(list(out.values())))
        rows = [self.exits(self.reach(window, low + i, s, high), high, ends) for i, s in entries]
        states = sorted(set().union(*rows))
        return entries, states, np.array([[r.get(s, _LOST) for s in states] for r in rows]).reshape(len(rows), len(states))

    def backtrace(self, window: str, low: int, high: int, entry: tuple[int, str], leave: tuple[int, str]) -> list[int]:
        """Ids of the pieces that start in the chunk, on the best path between two states."""
        def ids(start: int, state: str, at: int, end: str | None) -> list[int]:
            nodes = self.reach(window, start, state, at if end is None else high)
            here = nodes[at]
            return self.path(nodes, at, max(here, key=lambda s: here[s][0]) if end is None else end, start)

        def tail(start: int, state: str) -> list[int]:
            at = high + leave[0]
            cut = leave == (0, "") and (high == len(window) or self.is_cut(window, high))
            return ids(start, state, at, None if cut else leave[1])

        start, cuts = low + entry[0], self.inner_cuts(window, low + 1, high - 1)
        if cuts is None:
            return tail(start, entry[1])
        return ids(start, entry[1], cuts[0], None) + self.between_cuts(window[cuts[0]:cuts[1]]) + tail(cuts[1], "")


#: One per Python worker and file; workers serve many tasks.
_LOADED: dict[tuple[str, str], Vocabulary] = {}


def loaded(path: str, kind: str) -> Vocabulary:
    if (path, kind) not in _LOADED:
        _LOADED[path, kind] = Vocabulary(path, kind)
    return _LOADED[path, kind]


Transfer = tuple[list, list, np.ndarray]  # entry states, leave states, best weight from each to each


def combined(a: Transfer, b: Transfer) -> Transfer:
    """The transfer matrix of two neighbouring stretches: the max-plus product over the
    states of the border between them. It is associative, so any bracketing will do."""
    (entries, border, left), (own, leaves, right) = a, b
    place = {s: i for i, s in enumerate(border)}
    out = np.full((len(entries), len(leaves)), _LOST)
    for k, state in enumerate(own):
        if state in place:
            np.maximum(out, left[:, place[state], None] + right[k], out=out)
    return entries, leaves, out


def best_states(chunks: list[Transfer]) -> list[tuple]:
    """(entry state, exit state) of every chunk on the best path of one document: matrices of
    neighbours are combined in levels up to the whole document, and the states at the
    borders are chosen from there down, each from its two neighbours' matrices alone."""
    levels = [chunks]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([combined(*below[k:k + 2]) if k + 1 < len(below) else below[k] for k in range(0, len(below), 2)])
    entries, leaves, matrix = levels[-1][0]
    start = entries.index((0, ""))
    found = [((0, ""), leaves[int(matrix[start].argmax())])]
    for below in levels[-2::-1]:
        split: list[tuple] = []
        for k, (entry, leave) in enumerate(found):
            if 2 * k + 1 == len(below):
                split.append((entry, leave))
                continue
            (entries, border, left), (own, leaves, right) = below[2 * k:2 * k + 2]
            place = {s: i for i, s in enumerate(border)}
            row, column = left[entries.index(entry)], right[:, leaves.index(leave)]
            middle = own[int(np.argmax([row[place[s]] + column[i] if s in place else _LOST for i, s in enumerate(own)]))]
            split += [(entry, middle), (middle, leave)]
        found = split
    return found


_STATE = StructType([StructField("reach", IntegerType()), StructField("piece", StringType())])
_PLACE = [StructField("key", StringType()), StructField("no", LongType())]
_CHUNK = StructType([*_PLACE, StructField("window", StringType()), StructField("low", IntegerType()),
                     StructField("high", IntegerType())])
_MATRIX = StructType([*_CHUNK.fields, StructField("entries", ArrayType(_STATE)), StructField("leaves", ArrayType(_STATE)),
                      StructField("weights", ArrayType(DoubleType()))])
_BORDERS = StructType([*_PLACE, StructField("entry", _STATE), StructField("leave", _STATE)])
_IDS = StructType([*_PLACE, StructField("ids", ArrayType(IntegerType()))])


def _batch(rows: list[tuple], schema: StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema.fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, target, strict=True)],
                                      schema=target)


def _pairs(states: list[tuple[int, str]]) -> list[dict]:
    return [{"reach": i, "piece": p} for i, p in states]


def _tuples(states: list[dict]) -> list[tuple[int, str]]:
    return [(s["reach"], s["piece"]) for s in states]


def _giant_ids(giants: DataFrame, path: str, kind: str, chunk: int) -> DataFrame:
    """(key, ids) of the documents (key, text) by the chunked scan."""
    def split(batches):
        vocabulary = loaded(path, kind)
        before, after = vocabulary.longest, vocabulary.longest - 1
        for batch in batches:
            for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = vocabulary.prepared(text)
                for no, at in enumerate(range(0, len(text), chunk)):
                    low, end = max(0, at - before), min(len(text), at + chunk)
                    yield _batch([(key, no, text[low:end + after], at - low, end - low)], _CHUNK)

    def transfer(batches):
        vocabulary = loaded(path, kind)
        for batch in batches:
            for row in batch.to_pylist():
                entries, leaves, weights = vocabulary.transfer(row["window"], row["low"], row["high"])
                yield _batch([(*row.values(), _pairs(entries), _pairs(leaves), weights.ravel().tolist())], _MATRIX)

    def scan(batches):
        """Rows come in order of key and chunk; a document ends where the key changes."""
        key, held = None, {}

        def finish():
            found = best_states([held[no] for no in sorted(held)])
            rows = [(key, no, {"reach": e[0], "piece": e[1]}, {"reach": x[0], "piece": x[1]})
                    for no, (e, x) in zip(sorted(held), found, strict=True)]
            return _batch(rows, _BORDERS)

        for batch in batches:
            for row in batch.to_pylist():
                if row["key"] != key and held:
                    yield finish()
                    held = {}
                key = row["key"]
                entries, leaves = _tuples(row["entries"]), _tuples(row["leaves"])
                held[row["no"]] = entries, leaves, np.array(row["weights"]).reshape(len(entries), len(leaves))
        if held:
            yield finish()

    def backtrace(batches):
        vocabulary = loaded(path, kind)
        for batch in batches:
            for r in batch.to_pylist():
                ids = vocabulary.backtrace(r["window"], r["low"], r["high"], *_tuples([r["entry"], r["leave"]]))
                yield _batch([(r["key"], r["no"], ids)], _IDS)

    chunks = giants.select("key", "text").mapInArrow(split, _CHUNK).dropDuplicates(["key", "no"])
    held = stored(chunks.mapInArrow(transfer, _MATRIX), "sentencepiece-chunks")
    ordered = held.select("key", "no", "entries", "leaves", "weights").repartition("key").sortWithinPartitions("key", "no")
    borders = ordered.mapInArrow(scan, _BORDERS)
    rows = held.select("key", "no", "window", "low", "high").join(borders, ["key", "no"])
    ids = rows.mapInArrow(backtrace, _IDS)
    return ids.groupBy("key").agg(F.flatten(F.transform(
        F.sort_array(F.collect_list(F.struct("no", "ids"))), lambda x: x["ids"])).alias("ids"))


_OUT = StructType([StructField("ids", ArrayType(IntegerType())), StructField("round_trip", BooleanType())])


def encode(docs: DataFrame, path: str | None = None, carry: tuple[str, ...] = ("doc_id",), text: str = "text",
           kind: str = "bpe", chunk: int = CHUNK_CHARS) -> DataFrame:
    """Per row: the carried columns, `ids`, the pieces of the whole text by the model file
    at `path` (default: the public BPE model of 32k pieces), and `round_trip`: whether
    decoding them gives the text back (null for a null text)."""
    path = path or vocabulary_path("piece_bpe_32k.model")

    def make():
        vocabulary = loaded(path, kind)

        def work(texts):
            ids, back = [], []
            for t in texts:
                text = None if t is None else t.decode("utf-8")
                ids.append(None if text is None else vocabulary.encode(text))
                back.append(None if text is None else vocabulary.decode(ids[-1]) == text)
            return {"ids": ids, "round_trip": back}
        return work

    whole = F.col(text).cast("string")
    giant = F.coalesce(F.char_length(whole) >= chunk, F.lit(False))
    columns = {c: F.col(c) for c in carry}
    small = map_texts(docs.where(~giant), columns, whole, make, _OUT)
    giants = docs.where(giant)
    key = F.sha2(whole, 256)
    found = decode(_giant_ids(giants.select(key.alias("key"), whole.alias("text")), path, kind, chunk), path, kind=kind) \
        .select("key", "ids", (F.sha2("decoded", 256) == F.col("key")).alias("round_trip"))
    own = giants.select(*[c.alias(n) for n, c in columns.items()], key.alias("__key"))
    large = own.join(found, own["__key"] == found["key"], "left").select(*columns, "ids", "round_trip")
    return small.unionByName(large)


def decode(rows: DataFrame, path: str | None = None, ids: str = "ids", out: str = "decoded", kind: str = "bpe") -> DataFrame:
    """All columns and the text of the ids as `out`; null for null ids."""
    path = path or vocabulary_path("piece_bpe_32k.model")

    @F.pandas_udf("string")
    def text(column: pd.Series) -> pd.Series:
        vocabulary = loaded(path, kind)
        return column.map(lambda x: None if x is None else vocabulary.decode(x.tolist()))

    return rows.withColumn(out, text(F.col(ids)))


