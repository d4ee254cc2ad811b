"""Near-duplicates by a chosen-path set similarity join.

1. Every text becomes its set of word shingle hashes. Texts with one set are one class.
   A class carries PLACES minwise values and a parity bitmap of its set.
2. TREES independent trees branch the classes. A node chooses, by its own hash, one or
   two of the minwise places (1 / similarity on average) and sends each class to the
   children named by its values there. Similar classes stay together on some path of a
   tree with a probability that falls only slowly with its depth; others part soon. The
   first FIRST_DEPTH levels need no counts, as a path follows from a class alone.
3. Nodes of at most SMALL classes are compared exhaustively. In a larger one every class
   is compared with the node's least class; a node that kept nearly all classes of its
   parent, as only similar sets do, is settled; the classes of others branch on. What is
   still large at LAST_DEPTH is settled as well.
4. Candidate pairs pass a size test, the bitmap's exact bound on the difference, and a
   loose test of the minwise values (LEAST_EQUAL), and are then verified on full sets:
   first the best partner of each class, next pairs that are still in different
   components, last the pairs of settled nodes that are still in different components.
   So a large group of near copies is linked without forming all its pairs, and no pair
   of a common node whose ends are apart stays unseen.

Recall, for a pair just at the threshold: one tree misses it by depth 2 with probability
0.22, by depth 4 with 0.36, by depth 6 with 0.47; TREES trees miss it with 4e-7, 4e-5 and
5e-4. The loose test misses it with 3e-5. Pairs above the threshold fare better.

A document's component is the smallest doc_id it can reach over links.

Defined results: a null or blank text has an empty set and links with nothing; with fewer
words than a shingle the whole sequence counts as one; copies and repeated rows share a
class and are linked; a row with null doc_id gets the least id of its component, or null
(then kept, as it is alone); other columns are not read; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from riskgate.llm import words as W
from riskgate.llm.arrow import map_texts
from riskgate.llm.bloom import blocked_bloom, may_contain
from riskgate.llm.components import components
from riskgate.llm.storage import dropped, spread, stored

TREES, PLACES = 10, 64
FIRST_DEPTH, LAST_DEPTH, SMALL = 2, 6, 24
LEAST_EQUAL = 42
BITMAP_LONGS = 16
#: A node is settled when it has this share of its parent's classes, less than linked sets keep.
KEPT_BELOW_PCT = 5
#: Shingles hashed at once for the minwise values.
HASHED = 1 << 14

_ODD = (W.mix(np.arange(1, PLACES + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1))
_ROOTS = W.mix(np.arange(101, 101 + TREES, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))


class Near(NamedTuple):
    """Shingles of `words` words; linked when 100 * intersection >= percent * union."""
    words: int
    percent: int

    def overlap(self, total):
        """Least intersection of two linked sets with `total` members together."""
        return -(-self.percent * total // (100 + self.percent))


# -- step 1 -----------------------------------------------------------------------

def _sets(texts: list[bytes | None], rule: Near) -> list[np.ndarray]:
    firsts, _, hashes = W.many_words([t or b"" for t in texts], lower=True)
    return [W.shingle_set(hashes[a:b], rule.words) for a, b in zip(firsts[:-1], firsts[1:], strict=True)]


def minwise(sets: list[np.ndarray]) -> np.ndarray:
    """One row a set: 16 bits of the least value under each of PLACES hash functions."""
    out = np.full((len(sets), PLACES), ~np.uint64(0))
    if not sets:
        return out.astype(np.uint16)
    owner, values = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
    for at in range(0, len(values), HASHED):
        own = owner[at:at + HASHED]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        least = np.minimum.reduceat(values[at:at + HASHED, None] * _ODD, first, axis=0)
        out[own[first]] = np.minimum(out[own[first]], least)
    return (W.mix(out) >> np.uint64(20)).astype(np.uint16)


def bitmap(s: np.ndarray) -> np.ndarray:
    """Parity of the number of set members at each of 64 * BITMAP_LONGS places."""
    places = np.bincount((s & np.uint64(64 * BITMAP_LONGS - 1)).astype(np.int64), minlength=64 * BITMAP_LONGS)
    return np.packbits((places & 1).astype(np.uint8)).view(np.int64)


_SIGNATURE = StructType([StructField("n_shingles", LongType()), StructField("cls", BinaryType()),
                         StructField("minwise", BinaryType()), StructField("bits", ArrayType(LongType()))])


def _digest(s: np.ndarray) -> bytes:
    import xxhash
    return xxhash.xxh128_digest(s.tobytes())


def _signatures(docs: DataFrame, doc_id: str, text: str, rule: Near) -> DataFrame:
    """Per row: doc_id, text_hash, set size and class; minwise values and bitmap of a class
    come once in each slice of rows."""
    def work(texts):
        out = {f.name: [] for f in _SIGNATURE.fields}
        sets = _sets(texts, rule)
        keys = [_digest(s) if len(s) else None for s in sets]
        first = {k: i for i, k in reversed(list(enumerate(keys))) if k is not None}
        new = sorted(first.values())
        values = dict(zip(new, minwise([sets[i] for i in new]), strict=True))
        for i, (s, key) in enumerate(zip(sets, keys, strict=True)):
            own = i in values
            for name, value in zip(out, (len(s), key, values[i].tobytes() if own else None, bitmap(s) if own else None), strict=True):
                out[name].append(value)
        return out

    return map_texts(docs, {"doc_id": F.col(doc_id), "text_hash": _text_hash(text)}, F.col(text), lambda: work, _SIGNATURE)


def _text_hash(text: str) -> Column:
    return F.xxhash64(F.col(text).cast("string"))


# -- step 2 ------------------------------------------------------------------------

def branch(node: np.ndarray, values: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, child) of every child that the rows' nodes send them to: `values` holds each
    row's minwise values."""
    def child(rows, place):
        got = place.astype(np.uint64) << np.uint64(16) | values[rows, place]
        return W.mix(node[rows] ^ W.mix(got + np.uint64(1)))

    chance = W.mix(node + np.uint64(0x632BE59BD9B4E019))
    one = (chance % np.uint64(PLACES)).astype(np.int64)
    two = (one + 1 + (chance // np.uint64(PLACES) % np.uint64(PLACES - 1)).astype(np.int64)) % PLACES
    rows = np.arange(len(node))
    more = rows[(chance >> np.uint64(40)).astype(np.float64) / (1 << 24) < 100 / percent - 1]
    return np.append(rows, more), np.append(child(rows, one), child(more, two[more]))


_ENTRY = StructType([StructField("node", LongType()), StructField("cls", BinaryType()), StructField("n", LongType()),
                     StructField("parent", LongType())])


def _entries(rows: DataFrame, depth: int, percent: int) -> DataFrame:
    """(node, cls, n, parent) `depth` levels below the given node of each row, or below the
    roots of all trees where there is none; parent is handed on."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            values = np.frombuffer(b"".join(batch.column("minwise").to_pylist()), np.uint16).reshape(-1, PLACES)
            row = np.arange(batch.num_rows)
            if "node" in batch.schema.names:
                node = batch.column("node").to_numpy().view(np.uint64)
            else:
                row, node = np.repeat(row, TREES), np.tile(_ROOTS, batch.num_rows)
            for _ in range(depth):
                at, node = branch(node, values[row], percent)
                row = row[at]
            yield pa.RecordBatch.from_arrays(
                [pa.array(node.view(np.int64)), *[batch.column(c).take(pa.array(row)) for c in ("cls", "n", "parent")]],
                names=["node", "cls", "n", "parent"])

    return rows.mapInArrow(run, _ENTRY)


# -- step 3 ------------------------------------------------------------------------

def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _fits(a: str, b: str, rule: Near) -> Column:
    """Two sets of these sizes can be linked."""
    return 100 * F.least(a, b) >= rule.percent * F.greatest(a, b)


def _bits_fit(a: str, b: str, na: str, nb: str, rule: Near) -> Column:
    """The bitmaps leave room for a link: their difference bounds that of the sets from below."""
    differ = sum((F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(BITMAP_LONGS)), F.lit(0))
    total = F.col(na) + F.col(nb)
    return differ <= total - 2 * F.ceil(F.lit(rule.percent) * total / (100 + rule.percent))


def _close(pairs: DataFrame, classes: DataFrame, rule: Near) -> DataFrame:
    """(a, b, equal) of the pairs of classes that size, bitmap and minwise values leave."""
    @F.pandas_udf("int")
    def equal(x: pd.Series, y: pd.Series) -> pd.Series:
        both = [np.frombuffer(b"".join(v), np.uint16).reshape(len(v), PLACES) for v in (x, y)]
        return pd.Series((both[0] == both[1]).sum(axis=1).astype(np.int32))

    sides = (classes.select(F.col("cls").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits_{c}"),
                            F.col("minwise").alias(f"values_{c}")) for c in "ab")
    both = pairs.join(next(sides), "a").join(next(sides), "b")
    left = both.where(_fits("na", "nb", rule) & _bits_fit("bits_a", "bits_b", "na", "nb", rule))
    return left.select("a", "b", equal("values_a", "values_b").alias("equal")).where(F.col("equal") >= LEAST_EQUAL)


def _candidates(classes: DataFrame, rule: Near) -> tuple[list[DataFrame], list[DataFrame]]:
    """Tables of close pairs (a, b, equal), and of the settled nodes' entries (node, cls, n)."""
    pairs, settled = [], []
    at = _entries(spread(classes.select("cls", "n", "minwise", F.lit(None).cast("long").alias("parent"))), FIRST_DEPTH, rule.percent)
    for depth in range(FIRST_DEPTH, LAST_DEPTH + 1):
        entries = stored(at, "paths-entries")
        many = entries.groupBy("node").agg(F.count("*").alias("m"), F.min("cls").alias("least")).where("m > 1")
        shared = stored(entries.join(many, "node"), "paths-shared")
        dropped(entries)
        few = shared.where(F.col("m") <= SMALL)
        a, b = few.alias("x"), few.alias("y")
        small = a.join(b, F.col("x.node") == F.col("y.node")).where((F.col("x.cls") < F.col("y.cls")) & _fits("x.n", "y.n", rule)) \
            .select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"))
        large = shared.where(F.col("m") > SMALL)
        star = large.where("cls <> least")
        close = stored(_close(small.union(star.select(*_ordered(F.col("cls"), F.col("least")))).distinct(), classes, rule), "paths-pairs")
        pairs.append(close)
        similar = F.coalesce(100 * F.col("m") >= (rule.percent - KEPT_BELOW_PCT) * F.col("parent"), F.lit(False))
        settled.append(large.where(similar | F.lit(depth == LAST_DEPTH)).select("node", "cls", "n"))
        open_ = large.where(~similar).select("node", "cls", "n", F.col("m").alias("parent"))
        if depth == LAST_DEPTH or not open_.limit(1).count():
            break
        at = _entries(spread(open_.join(classes.select("cls", "minwise"), "cls"), "cls", "node"), 1, rule.percent)
    return pairs, settled


# -- step 4 ------------------------------------------------------------------------

def _texts(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(cls, text) of the wanted classes, from one document of each."""
    keyed = wanted.select("cls", F.xxhash64("rep.id", "rep.text_hash").alias("key"))
    named = docs.select(F.col(text).cast("string").alias("text"), F.xxhash64(F.col(doc_id), _text_hash(text)).alias("key"))
    rows = may_contain(named, "key", blocked_bloom(keyed, "key", keyed.count()), "passes").where("passes")
    return rows.join(keyed, "key").dropDuplicates(["cls"]).select("cls", "text")


def _verified(pairs: DataFrame, texts: DataFrame, rule: Near) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets reach the threshold."""
    @F.pandas_udf("boolean")
    def linked(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(*(_sets([t.encode() for t in v], rule) for v in (x, y)), strict=True):
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(100 * both >= rule.percent * (len(p) + len(q) - both))
        return pd.Series(out, dtype=bool)

    sides = (texts.select(F.col("cls").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    return pairs.select("a", "b").join(next(sides), "a").join(next(sides), "b") \
        .where(linked("text_a", "text_b")).select("a", "b")


def _merged(members: DataFrame, links: DataFrame) -> DataFrame:
    """(cls, root) with the roots that further links between classes give."""
    ends = [members.select(F.col("cls").alias(c), F.col("root").alias(f"r{c}")) for c in "ab"]
    found = components(links.join(ends[0], "a").join(ends[1], "b"), "ra", "rb")
    tops = found.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return members.join(tops, "root", "left").select("cls", F.coalesce("top", "root").alias("root"))


def _apart(pairs: DataFrame, members: DataFrame) -> DataFrame:
    sides = (members.select(F.col("cls").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
    return pairs.join(next(sides), "a").join(next(sides), "b").where("ra <> rb").select(*pairs.columns)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out


def _linked_classes(classes: DataFrame, rule: Near, texts_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(cls, root) of every class that is a candidate of any pair."""
    pairs, settled = _candidates(classes, rule)
    close = stored(_union(pairs).groupBy("a", "b").agg(F.max("equal").alias("equal")), "paths-close")
    held = _union(settled)
    ends = close.select(F.col("a").alias("cls")).union(close.select(F.col("b").alias("cls"))) \
        .union(held.select("cls")).distinct()
    members = stored(ends.withColumn("root", F.col("cls")), "paths-members")
    texts = stored(texts_of(classes.join(members, "cls", "left_semi")), "paths-texts")
    # first the best partner of each class
    either = close.select("a", "b", "equal", F.col("a").alias("cls")).union(close.select("a", "b", "equal", F.col("b").alias("cls")))
    best = either.groupBy("cls").agg(F.max(F.struct("equal", "a", "b")).alias("best")).select("best.a", "best.b").distinct()
    members = stored(_merged(members, stored(_verified(best, texts, rule), "paths-links")), "paths-members")
    # then the other pairs whose ends are apart
    rest = _apart(close.join(best, ["a", "b"], "left_anti"), members)
    members = stored(_merged(members, stored(_verified(rest, texts, rule), "paths-links")), "paths-members")
    # last the settled nodes in which classes are apart
    rooted = held.join(members, "cls")
    mixed = rooted.groupBy("node").agg(F.min("root").alias("least"), F.max("root").alias("greatest")) \
        .where("least <> greatest").select("node")
    rooted = stored(rooted.join(mixed, "node", "left_semi").join(classes.select("cls", "bits"), "cls"), "paths-mixed")
    a, b = rooted.alias("x"), rooted.alias("y")
    cross = a.join(b, (F.col("x.node") == F.col("y.node")) & (F.col("x.cls") < F.col("y.cls")) & (F.col("x.root") != F.col("y.root"))
                   & _fits("x.n", "y.n", rule) & _bits_fit("x.bits", "y.bits", "x.n", "y.n", rule)) \
        .select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct()
    cross = _close(cross.join(close, ["a", "b"], "left_anti"), classes, rule)
    return _merged(members, stored(_verified(cross, texts, rule), "paths-links"))


def near_duplicates(docs: DataFrame, rule: Near, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles (set size), component_id, kept."""
    rows = stored(_signatures(docs, doc_id, text, rule), "paths-signatures")
    classes = stored(rows.where("n_shingles > 0").groupBy("cls").agg(
        F.min("n_shingles").alias("n"), F.min("minwise").alias("minwise"), F.min("bits").alias("bits"),
        F.min("doc_id").alias("least_id"), F.max(F.struct(F.col("doc_id").alias("id"), "text_hash")).alias("rep")), "paths-classes")
    linked = _linked_classes(classes, rule, lambda wanted: _texts(docs, wanted, doc_id, text))
    rooted = classes.select("cls", "least_id").join(linked, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.join(least, "root").select("cls", "component_id")
    out = rows.select("doc_id", "n_shingles", "cls").join(named, "cls", "left") \
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
