"""Ranked lexical search over document FP-trees.

1. Items are taken in blocks of bounded text (by hash, as many blocks as the item table
   needs); a block's terms are the only ones that documents are read for.
2. One pass over the documents counts N, L and each term's df; tasks hand on sums only.
3. A second pass restricts every document to the block's terms, rare ones first, with
   its tf and m. A task puts its documents, CHUNK at a time, into a tree in which equal
   beginnings share a path (single-child paths are one edge). Each node holds, for its
   children together, which terms occur below a child, with the greatest tf, and the
   least m. A term's part of the score grows with tf and falls with m, so the same
   formula bounds every document below, and is exact for a single document.
4. Each item goes depth first through the tree, best bound first, and leaves out what
   cannot reach its RANKS-th score of the task so far; equal bounds are followed, as a
   smaller doc_id may win.
5. The tasks' lists are merged by two ranked windows, so no single task sees all lists.

The result is exact. Terms are told apart by 64-bit hashes; documents with equal vectors
and m are one leaf with their RANKS least ids (others can't rank).

Defined results: null or termless documents and items have no matches; rows with equal
item_id and text are one item; every document row counts, repeated ones too, a null
doc_id ranks after others of its score; empty tables give no rows; other columns are
not read.
"""

from __future__ import annotations

import math
from bisect import insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from riskgate.llm import words as W
from riskgate.llm.storage import dropped, stored

RANKS = 20
#: Characters of item text that one block may hold, and documents and terms of one tree.
BLOCK_CHARS, CHUNK, CHUNK_TERMS = 4_000_000, 4096, 1_000_000
#: Lists of tasks are merged in so many parts first.
MERGE_PARTS = 64

_SCALE, _TF, _M = 1_000_000_000, 1000, 12  # fixed values of the score


def part(tf, m):
    """What a term of weight 1 adds to a document's score."""
    return (_SCALE * tf) // (_TF * tf + _M * m)


def length_norm(n: int, docs: int, terms: int) -> int:
    """m of a document with n terms."""
    return 100 - 25 + (25 * n * docs) // terms


# -- passes over the documents -----------------------------------------------------

class Vectors(NamedTuple):
    """Some documents restricted to a vocabulary: number of all terms per document, and
    sorted (document, term, tf)."""
    n_terms: np.ndarray
    doc: np.ndarray
    term: np.ndarray
    tf: np.ndarray


def restricted(texts: list[bytes | None], hashes: np.ndarray, number: np.ndarray) -> Vectors:
    """`hashes` are the sorted hashes of the vocabulary, `number` their term numbers."""
    firsts, _, found = W.many_words([t or b"" for t in texts], lower=True, letters=True)
    n_terms = np.diff(firsts)
    doc = np.repeat(np.arange(len(texts)), n_terms)
    at = np.minimum(np.searchsorted(hashes, found), max(len(hashes) - 1, 0))
    known = hashes[at] == found if len(hashes) else np.zeros(len(found), dtype=bool)
    width = max(len(hashes), 1)
    key, tf = np.unique(doc[known] * width + number[at[known]], return_counts=True)
    return Vectors(n_terms, key // width, key % width, tf.astype(np.int64))


def _text_batches(batches: Iterator, text: int) -> Iterator:
    from riskgate.llm.arrow import slices, texts_of

    for whole in batches:
        for batch in slices(whole, text):
            yield batch, texts_of(batch.column(text))


_COUNTS = StructType([StructField("term", IntegerType()), StructField("count", LongType())])


def _corpus_counts(docs: DataFrame, text: str, hashes: np.ndarray) -> tuple[int, int, np.ndarray]:
    """(N, L, df of each term)."""
    sent = docs.sparkSession.sparkContext.broadcast(hashes)

    def count(batches):
        import pyarrow as pa

        known, number = sent.value, np.arange(len(sent.value))
        total = np.zeros(len(known) + 2, dtype=np.int64)
        for _, texts in _text_batches(batches, 0):
            got = restricted(texts, known, number)
            total[:-2] += np.bincount(got.term, minlength=len(known))
            total[-2:] += np.count_nonzero(got.n_terms), got.n_terms.sum()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["term", "count"])

    rows = docs.select(F.col(text).cast("string")).where(F.col(text).isNotNull()).mapInArrow(count, _COUNTS)
    out = np.zeros(len(hashes) + 2, dtype=np.int64)
    for row in rows.groupBy("term").agg(F.sum("count").alias("count")).toLocalIterator():
        out[row["term"]] = row["count"]
    sent.destroy()
    return int(out[-2]), int(out[-1]), out[:-2]


# -- the tree ------------------------------------------------------------------------

class Node(NamedTuple):
    """The children of an inner node, by term: `terms[k]` occurs below the children
    `child[start[k]:start[k + 1]]`, at most `tf` times in one document."""
    terms: np.ndarray
    start: np.ndarray
    child: np.ndarray
    tf: np.ndarray
    m: np.ndarray
    nodes: list


def _inner(children: list) -> tuple[np.ndarray, np.ndarray, int, Node]:
    """(terms, greatest tf, least m, node) of an inner node over (terms, tf, m, node) of its children."""
    terms = np.concatenate([c[0] for c in children])
    order = np.argsort(terms, kind="stable")
    child = np.repeat(np.arange(len(children)), [len(c[0]) for c in children])[order]
    tf = np.concatenate([c[1] for c in children])[order]
    terms = terms[order]
    start = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])[:len(terms)])
    m = np.array([c[2] for c in children], dtype=np.int64)
    node = Node(terms[start], np.append(start, len(terms)), child, tf, m, [c[3] for c in children])
    most = np.maximum.reduceat(tf, start) if len(start) else tf
    return node.terms, most, int(m.min()), node


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def tree(rows: list[tuple]) -> Node:
    """The tree of documents given as (terms ascending, tf, m, id); a leaf is a list of ids."""
    leaves: dict[bytes, tuple] = {}
    for terms, tf, m, ident in rows:
        key = terms.astype(">u4").tobytes() + b"|" + tf.tobytes() + m.to_bytes(16)
        insort(leaves.setdefault(key, (terms, tf, m, []))[3], ident)
        del leaves[key][3][RANKS:]
    ordered = sorted(leaves.values(), key=lambda x: x[0].astype(">u4").tobytes())
    open_: list[tuple[int, list]] = [(0, [])]  # inner nodes on the path: (depth, children)

    def close(depth: int) -> None:
        """End the nodes of the path deeper than `depth`; one at `depth` takes the last."""
        while open_[-1][0] > depth:
            done = _inner(open_.pop()[1])
            if open_[-1][0] < depth:
                open_.append((depth, [done]))
            else:
                open_[-1][1].append(done)

    for k, leaf in enumerate(ordered):
        ahead = _shared(leaf[0], ordered[k + 1][0]) if k + 1 < len(ordered) else 0
        if ahead > open_[-1][0]:
            open_.append((ahead, [leaf]))
        else:
            open_[-1][1].append(leaf)
            close(ahead)
    return _inner(open_[0][1])[3]


def bounds(node: Node, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The greatest score that a document below each child can have."""
    at = np.searchsorted(node.terms, terms)
    hit = np.flatnonzero(at < len(node.terms))
    hit = hit[node.terms[at[hit]] == terms[hit]]
    begin = node.start[at[hit]]
    many = node.start[at[hit] + 1] - begin
    out = np.zeros(len(node.m), dtype=np.int64)
    if len(hit):
        pick = np.arange(many.sum()) + np.repeat(begin - (np.cumsum(many) - many), many)
        child = node.child[pick]
        np.add.at(out, child, np.repeat(weights[hit], many) * part(node.tf[pick], node.m[child]))
    return out


def search(root: Node, terms: np.ndarray, weights: np.ndarray, best: list[tuple]) -> None:
    """Improve `best`, the sorted (-score, id) of an item, by the documents of a tree."""
    todo = [(None, root)]
    while todo:
        bound, node = todo.pop()
        if bound is not None and len(best) == RANKS and bound < -best[-1][0]:
            continue
        if isinstance(node, list):
            for ident in node:
                insort(best, (-bound, ident))
            del best[RANKS:]
            continue
        score = bounds(node, terms, weights)
        least = max(1, -best[-1][0]) if len(best) == RANKS else 1
        able = np.flatnonzero(score >= least)
        todo += [(int(score[k]), node.nodes[k]) for k in able[np.argsort(score[able], kind="stable")]]


# -- the operator --------------------------------------------------------------------

def _item_terms(texts: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The sorted term hashes of all items, and each item's (places in them, repeats)."""
    firsts, _, found = W.many_words([t.encode() for t in texts], lower=True, letters=True)
    hashes, place = np.unique(found, return_inverse=True)
    return hashes, [np.unique(place[a:b], return_counts=True) for a, b in zip(firsts[:-1], firsts[1:], strict=True)]


def _search_block(docs: DataFrame, items: list, doc_id: str, text: str, schema: StructType) -> DataFrame:
    """The RANKS best documents of every task for the items of one block."""
    hashes, found = _item_terms([r["text"] for r in items])
    n_docs, n_terms, df = _corpus_counts(docs, text, hashes)
    order = np.argsort(df, kind="stable")  # rare terms get low numbers
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.arange(len(order))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)
    wanted = []
    for (place, repeats), row in zip(found, items, strict=True):
        place, repeats = place[df[place] > 0], repeats[df[place] > 0]
        by = np.argsort(number[place])
        wanted.append((row["item"], row["item_id"], number[place][by], (weight[place] * repeats)[by]))
    sent = docs.sparkSession.sparkContext.broadcast((hashes, number, wanted))

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        known, numbers, asked = sent.value
        best: list[list[tuple]] = [[] for _ in asked]
        held, size = [], 0

        def use():
            root = tree(held)
            for mine, (_, _, terms, weights) in zip(best, asked, strict=True):
                search(root, terms, weights, mine)

        for batch, texts in _text_batches(batches, 1):
            got = restricted(texts, known, numbers)
            cuts = np.searchsorted(got.doc, np.arange(len(texts) + 1))
            for k, ident in enumerate(batch.column(0).to_pylist()):
                a, b = cuts[k], cuts[k + 1]
                if a < b:
                    m = length_norm(int(got.n_terms[k]), n_docs, n_terms)
                    held.append((got.term[a:b], got.tf[a:b], m, (ident is None, ident or 0)))
                    size += b - a
                if len(held) >= CHUNK or size >= CHUNK_TERMS:
                    use()
                    held, size = [], 0
        if held:
            use()
        out = [(item, item_id, None if null else ident, -score)
               for (item, item_id, _, _), mine in zip(asked, best, strict=True) for score, (null, ident) in mine]
        target = to_arrow_schema(schema)
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(target)], schema=target)

    rows = docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).where(F.col(text).isNotNull())
    lists = rows.mapInArrow(run, schema)
    order_by = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    parts = lists.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGE_PARTS)))
    some = parts.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order_by))) \
        .where(F.col("rank") <= RANKS)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order_by))) \
        .where(F.col("rank") <= RANKS).select("item_id", "rank", "doc_id", "score")
    result = stored(ranked, "search-ranked")
    sent.destroy()
    return result


def lexical_search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the RANKS best documents of every item."""
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text")) \
        .where("text is not null").distinct()
    asked = stored(asked.withColumn("item", F.monotonically_increasing_id()), "search-items")
    chars = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    schema = StructType([asked.schema["item"], asked.schema["item_id"], StructField("doc_id", LongType()),
                         StructField("score", LongType())])
    own = F.pmod(F.xxhash64("item"), F.lit(blocks))
    parts = [_search_block(docs, asked.where(own == k).collect(), doc_id, text, schema) for k in range(blocks)]
    dropped(asked)
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
