"""Jaccard join on word shingles by grouped prefixes.

1. Every text becomes its set of n-word shingle hashes. Texts with the same set are one
   class (a map-side combined aggregate), so copies cost nothing further.
2. The shingles of a set are put in one global order, rare ones first. Rarity comes
   from a count sketch over all documents (SKETCH_BITS; every task adds up its own
   counts, so one array per task is shuffled, never a shingle). Any order that all sets
   share gives exact results; rarity only keeps the lists of a shingle short.
3. Two sets can reach the threshold only if their prefixes share a shingle. Classes
   with identical prefix and size form one group, which enters the lists of its prefix
   shingles once a task. Lists of a single group are dropped; the others give group
   pairs, under size and position filters.
4. Group pairs are expanded to class pairs. A parity bitmap of each set bounds their
   symmetric difference from below and removes most, and the rest is verified on the
   whole sets.
5. Linking works in three rounds, because a large group of near copies would otherwise
   emit all its pairs: first every group is paired with its NEIGHBOURS next ones, by
   size, in each list; then, in lists with several components, with up to NEIGHBOURS of
   the WINDOW next ones that lie in another component and whose folded bitmap fits; last
   all pairs whose ends are still in different components are formed and verified. Each
   round sees the components of the one before. No link between components is lost.

A document's component is the smallest doc_id it can reach over links.

Defined results: a null or blank text has an empty set, size 0, and links with
nothing; with fewer than n words the whole sequence is one shingle; repeated rows and
copies share a class; a row with null doc_id gets the least id of its component, or
null; other columns are not read. Shingles are told apart by 64-bit hashes, classes by
128 bits; groups that share a 64-bit id are only compared more often.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BinaryType, IntegerType, LongType, StructField, StructType)

from riskgate.llm import words as W
from riskgate.llm.arrow import map_texts
from riskgate.llm.bloom import blocked_bloom, may_contain
from riskgate.llm.components import components
from riskgate.llm.storage import dropped, stored

SKETCH_BITS = 21
SLICE_BITS = 14
BITMAP_LONGS = 16
NEIGHBOURS = 6
WINDOW = 64
#: Texts of pairs that are verified at once hold about so many characters, or are of one pair.
PAIR_CHARS = 1 << 20


class Rule(NamedTuple):
    """Shingles of `words` words; linked when 100 * intersection >= percent * union."""
    words: int
    percent: int

    def overlap(self, a, b):
        """Least intersection of two linked sets of sizes a and b."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def probe(self, n):
        """Prefix length of a set as the larger one of a pair."""
        return n - -(-self.percent * n // 100) + 1

    def index(self, n):
        """Prefix length of a set as the smaller one of a pair."""
        return n - self.overlap(n, n) + 1


def _sets(texts: list[bytes | None], rule: Rule) -> list[np.ndarray]:
    firsts, _, hashes = W.many_words([t or b"" for t in texts], lower=True)
    return [W.shingle_set(hashes[a:b], rule.words) for a, b in zip(firsts[:-1], firsts[1:], strict=True)]


# -- step 2: how common each shingle is ---------------------------------------

def rarity(docs: DataFrame, text: str, rule: Rule) -> np.ndarray:
    """Logarithmic document counts per hash bucket: 2**SKETCH_BITS bytes whatever the
    input, which is what reaches the driver and is broadcast."""
    width = 1 << SLICE_BITS
    schema = StructType([StructField("part", IntegerType()), StructField("counts", BinaryType())])

    def count(batches):
        import pyarrow as pa

        from riskgate.llm.arrow import slices, texts_of

        held = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        for whole in batches:
            for batch in slices(whole, 0):
                found = _sets(texts_of(batch.column(0)), rule)
                if found:
                    place, n = np.unique(np.concatenate(found) >> np.uint64(64 - SKETCH_BITS), return_counts=True)
                    held[place] += n.astype(np.uint32)
        parts = [(i, held[i * width:(i + 1) * width]) for i in range(len(held) // width)]
        parts = [(i, x) for i, x in parts if x.any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in parts], pa.int32()),
             pa.array([(x.astype(np.uint16) if x.max() < 65536 else x).tobytes() for _, x in parts], pa.binary())],
            names=["part", "counts"])

    def add(frames):
        """Logarithms of the sums; all counts of a slice are in one task."""
        total: dict[int, np.ndarray] = {}
        for frame in frames:
            for part, raw in zip(frame["part"], frame["counts"], strict=True):
                total.setdefault(part, np.zeros(width, dtype=np.uint64))
                total[part] += np.frombuffer(raw, dtype=np.uint16 if len(raw) == 2 * width else np.uint32)
        yield pd.DataFrame({"part": list(total), "counts": [
            (2 * np.log2(x.astype(np.float64) + 1)).astype(np.uint8).tobytes() for x in total.values()]})

    parts = docs.select(F.col(text).cast("string")).where(F.col(text).isNotNull()).mapInArrow(count, schema)
    common = np.zeros(1 << SKETCH_BITS, dtype=np.uint8)
    for row in parts.repartition("part").mapInPandas(add, schema).collect():
        common[row["part"] * width:(row["part"] + 1) * width] = np.frombuffer(row["counts"], dtype=np.uint8)
    return common


# -- step 1: sets, classes and groups ------------------------------------------

_SIGNATURE = StructType([
    StructField("n_shingles", LongType()), StructField("cls", BinaryType()), StructField("grp", LongType()),
    StructField("prefix", ArrayType(LongType())), StructField("bitmap", ArrayType(LongType())),
    StructField("fold1", LongType()), StructField("fold2", LongType())])


def _digest(values: np.ndarray) -> bytes:
    import xxhash
    return xxhash.xxh128_digest(values.tobytes())


def _group(prefix: np.ndarray, n: int) -> int:
    return int.from_bytes(_digest(np.append(prefix, np.uint64(n)))[:8], "little", signed=True)


def _bitmap(s: np.ndarray) -> np.ndarray:
    bits = np.bincount((s & np.uint64(64 * BITMAP_LONGS - 1)).astype(np.int64), minlength=64 * BITMAP_LONGS)
    return np.packbits((bits & 1).astype(np.uint8)).view(np.int64)


def _folded(bitmap: np.ndarray) -> tuple[int, int]:
    """The bitmap folded to 128 bits: a parity bitmap again, with fewer places."""
    one, two = np.bitwise_xor.reduce(bitmap.reshape(-1, 2), axis=0)
    return int(one), int(two)


def signatures(docs: DataFrame, doc_id: str, text: str, rule: Rule) -> DataFrame:
    """Per row: set size, class and group keys, and, once a slice of rows for each class,
    the prefix in the global order and the bitmap. Stored, so that the broadcast ends."""
    common = docs.sparkSession.sparkContext.broadcast(rarity(docs, text, rule))  # 2 ** SKETCH_BITS bytes

    def make():
        def work(texts):
            seen: dict[bytes, int] = {}
            out = {f.name: [] for f in _SIGNATURE.fields}
            for s in _sets(texts, rule):
                key, group, prefix, bitmap, folds = _digest(s) if len(s) else None, None, None, None, (None, None)
                if key in seen:
                    group = seen[key]
                elif key is not None:
                    order = np.argsort(common.value[s >> np.uint64(64 - SKETCH_BITS)], kind="stable")
                    prefix, bitmap = s[order[:rule.probe(len(s))]], _bitmap(s)
                    seen[key], folds = _group(prefix, len(s)), _folded(bitmap)
                    group = seen[key]
                row = (len(s), key, group, None if prefix is None else prefix.view(np.int64), bitmap, *folds)
                for name, value in zip(out, row, strict=True):
                    out[name].append(value)
            return out
        return work

    rows = map_texts(docs, {"doc_id": F.col(doc_id), "text_hash": _text_hash(text)}, F.col(text), make, _SIGNATURE)
    rows = stored(rows, "jaccard-signatures")
    common.destroy()
    return rows


# -- step 3: group pairs --------------------------------------------------------

_LIST = StructType([StructField("token", LongType()), StructField("place", LongType()), StructField("grp", LongType())])
_PAIR = StructType([StructField("ga", LongType()), StructField("gb", LongType())])


def _lists(rows: DataFrame) -> DataFrame:
    """(token, place, grp) of all prefix shingles that several groups share; `place` holds
    the set's size and the shingle's position: size * 2**32 + position. Lists are in order
    of size, then group, so near copies have the same neighbours in all their lists."""
    entries = rows.where("prefix is not null").select(
        "grp", "n_shingles", F.posexplode("prefix").alias("pos", "token")) \
        .select("token", (F.col("n_shingles") * F.lit(1 << 32) + F.col("pos")).alias("place"), "grp")
    ordered = entries.repartition("token").sortWithinPartitions("token", F.shiftright("place", 32), "grp")

    def shared(batches):
        """Rows whose list has another group; only the last row waits for the next batch."""
        import pyarrow as pa

        names = [f.name for f in _LIST.fields]
        held, before = [np.empty(0, np.int64)] * 3, False
        for batch in batches:
            t, p, g = (np.append(h, c.to_numpy()) for h, c in zip(held, batch.columns, strict=True))
            new = np.ones(len(t), dtype=bool)
            new[1:] = (t[1:] != t[:-1]) | (g[1:] != g[:-1])
            t, p, g = t[new], p[new], g[new]
            same = t[1:] == t[:-1]
            keep = np.zeros(len(t), dtype=bool)
            keep[0] = before
            keep[1:] |= same
            keep[:-1] |= same
            before, held = bool(keep[-1]), [t[-1:], p[-1:], g[-1:]]
            out = keep[:-1]
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[:-1][out]) for x in (t, p, g)], names=names)
        if before:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=names)

    return ordered.mapInArrow(shared, _LIST)


def _size(place):
    return place >> 32


def _position(place):
    return place & 0xFFFFFFFF


def _neighbour_pairs(lists: DataFrame, rule: Rule) -> DataFrame:
    """Each group with the NEIGHBOURS groups before it in a list, by size, as far as the
    filters let them. Rows come in the order in which they were written."""
    def pairs(batches):
        import pyarrow as pa

        held = [np.empty(0, np.int64)] * 3
        for batch in batches:
            old = len(held[0])
            t, p, g = (np.append(h, c.to_numpy()) for h, c in zip(held, batch.columns, strict=True))
            held = [x[-NEIGHBOURS:] for x in (t, p, g)]
            found = []
            for k in range(1, NEIGHBOURS + 1):
                b = np.arange(max(old, k), len(t))
                b = b[t[b] == t[b - k]]
                na, pa_, nb, pb = _size(p[b - k]), _position(p[b - k]), _size(p[b]), _position(p[b])
                fits = (pa_ < rule.index(na)) & (100 * na >= rule.percent * nb) \
                    & (np.minimum(na - pa_, nb - pb) >= rule.overlap(na, nb))
                found.append((g[b - k][fits], g[b][fits]))
            both = np.unique(np.stack([np.concatenate(x) for x in zip(*found, strict=True)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["ga", "gb"])

    return lists.mapInArrow(pairs, _PAIR).distinct()


def _mixed_lists(lists: DataFrame, groups: DataFrame) -> DataFrame:
    """The lists whose groups lie in several components, in the same order. `groups` has the
    side of a group (its component; one of its own if it is in several) and the folded
    bitmap of its one class (null: several classes)."""
    whole = Window.partitionBy("token").orderBy(F.shiftright("place", 32), "grp") \
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = lists.join(groups, "grp").withColumn("least", F.min("side").over(whole)).withColumn("most", F.max("side").over(whole))
    return rows.where("least <> most").select("token", "place", "grp", "side", "fold1", "fold2")


def _window_pairs(mixed: DataFrame, rule: Rule) -> DataFrame:
    """Each group with up to NEIGHBOURS of the WINDOW groups before it in a list: those that
    the filters and folded bitmaps let it link with and that lie in other components. Rows
    come in the order in which they were written."""
    def pairs(batches):
        import pyarrow as pa

        held = [np.empty(0, np.int64)] * 6
        for batch in batches:
            old = len(held[0])
            columns = [np.append(h, c.to_numpy()) for h, c in zip(held, batch.columns, strict=True)]
            held = [x[-WINDOW:] for x in columns]
            t, p, g, side, one, two = columns
            n, pos = _size(p), _position(p)
            fold = np.stack([one, two])
            b, left = np.arange(old, len(t)), np.full(len(t), NEIGHBOURS)
            found = [(g[:0], g[:0])]
            for k in range(1, WINDOW + 1):
                b = b[(b >= k) & (left[b] > 0)]
                b = b[t[b] == t[b - k]]
                a = b - k
                need = rule.overlap(n[a], n[b])
                differ = np.bitwise_count(fold[:, a] ^ fold[:, b]).sum(axis=0, dtype=np.int64)
                fits = (side[a] != side[b]) & (pos[a] < rule.index(n[a])) & (100 * n[a] >= rule.percent * n[b]) \
                    & (np.minimum(n[a] - pos[a], n[b] - pos[b]) >= need) & (differ <= n[a] + n[b] - 2 * need)
                left[b[fits]] -= 1
                found.append((g[a][fits], g[b][fits]))
            both = np.unique(np.stack([np.concatenate(x) for x in zip(*found, strict=True)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["ga", "gb"])

    rows = mixed.where("fold1 is not null").select("token", "place", "grp", F.xxhash64("side").alias("side"), "fold1", "fold2")
    return rows.mapInArrow(pairs, _PAIR).distinct()


def _cross_pairs(lists: DataFrame, groups: DataFrame, rule: Rule) -> DataFrame:
    """All pairs of a list's groups that lie in different components so far, by the sides and
    folded bitmaps of `groups` (see _mixed_lists), which rule out most pairs here."""
    n, pos = F.shiftright("place", 32), F.col("place").bitwiseAND(F.lit(0xFFFFFFFF))
    index = n - F.ceil(F.lit(2 * rule.percent) * n / (100 + rule.percent)) + 1
    rows = lists.join(groups, "grp").select(
        "token", "grp", "side", "fold1", "fold2", n.alias("n"), pos.alias("pos"), (pos < index).alias("short"))
    a, b = rows.where("short").alias("a"), rows.alias("b")
    na, pa, nb, pb = (F.col(c) for c in ("a.n", "a.pos", "b.n", "b.pos"))
    need = F.ceil(F.lit(rule.percent) * (na + nb) / (100 + rule.percent))
    differ = F.bit_count(F.col("a.fold1").bitwiseXOR(F.col("b.fold1"))) \
        + F.bit_count(F.col("a.fold2").bitwiseXOR(F.col("b.fold2")))
    return a.join(b, F.col("a.token") == F.col("b.token")).where(
        (F.struct("a.n", "a.grp") < F.struct("b.n", "b.grp")) & (F.col("a.side") != F.col("b.side"))
        & (F.lit(100) * na >= F.lit(rule.percent) * nb) & (F.least(na - pa, nb - pb) >= need)
        & F.coalesce(differ <= na + nb - 2 * need, F.lit(True))) \
        .select(F.col("a.grp").alias("ga"), F.col("b.grp").alias("gb")).distinct()


# -- step 4: verification -------------------------------------------------------

def _text_hash(text: str) -> Column:
    return F.xxhash64(F.col(text).cast("string"))


def _texts(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(cls, text) of the wanted classes, from a document of each (repeated rows repeat it).
    Texts travel, not sets: they are smaller and compress."""
    keyed = wanted.select("cls", F.xxhash64("rep.id", "rep.text_hash").alias("key"))
    bloom = blocked_bloom(keyed, "key", keyed.count())
    named = docs.select(F.col(text).cast("string").alias("text"), F.xxhash64(F.col(doc_id), _text_hash(text)).alias("key"))
    return may_contain(named, "key", bloom, "passes").where("passes").join(keyed, "key").select("cls", "text")


def _close(pairs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """Class pairs (a, b) that their bitmaps don't rule out."""
    a, b = (classes.select(F.col("cls").alias(c), F.col("bitmap").alias(f"m{c}"), F.col("n").alias(f"n{c}")) for c in "ab")
    differ = sum((F.bit_count(F.col("ma")[k].bitwiseXOR(F.col("mb")[k])) for k in range(BITMAP_LONGS)), F.lit(0))
    total = F.col("na") + F.col("nb")
    need = F.ceil(F.lit(rule.percent) * total / (100 + rule.percent))
    return pairs.join(a, "a").join(b, "b").where(differ <= total - 2 * need).select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """Class pairs (a, b) whose whole sets reach the threshold, and are those of the classes."""
    @F.pandas_udf("boolean")
    def linked(a: pd.Series, x: pd.Series, b: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        part = ((x.str.len() + y.str.len()).cumsum() // PAIR_CHARS).to_numpy()  # sets of a few pairs at a time
        for rows in np.split(np.arange(len(part)), np.flatnonzero(np.diff(part)) + 1):
            sides = (_sets([t.encode() for t in v.iloc[rows]], rule) for v in (x, y))
            for p, q, s, t in zip(a.iloc[rows], b.iloc[rows], *sides, strict=True):
                both = len(np.intersect1d(s, t, assume_unique=True))
                out.append(100 * both >= rule.percent * (len(s) + len(t) - both) and _digest(s) == bytes(p) and _digest(t) == bytes(q))
        return pd.Series(out, dtype=bool)

    a, b = (texts.select(F.col("cls").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")
    return pairs.join(a, "a").join(b, "b").where(linked("a", "ta", "b", "tb")).select("a", "b").distinct()


# -- all steps ---------------------------------------------------------------------

def jaccard_components(docs: DataFrame, rule: Rule, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles (set size), component_id, and what tells components and
    rows apart where ids repeat: `root` (null for an empty set) and `text_hash`."""
    whole = signatures(docs, doc_id, text, rule)
    rows = stored(whole.select("doc_id", "n_shingles", "cls", "text_hash"), "jaccard-rows")
    classes = stored(whole.where("n_shingles > 0").groupBy("cls").agg(
        F.min("grp").alias("grp"), F.min("n_shingles").alias("n"), F.min("bitmap").alias("bitmap"),
        F.min("fold1").alias("fold1"), F.min("fold2").alias("fold2"), F.min("doc_id").alias("least_id"), F.count("*").alias("copies"),
        F.max(F.struct(F.col("doc_id").alias("id"), "text_hash")).alias("rep")), "jaccard-classes")
    lists = stored(_lists(whole), "jaccard-lists")
    dropped(whole)

    def expanded(group_pairs: DataFrame, members: DataFrame) -> DataFrame:
        """Pairs of the classes of two groups that are not yet in one component."""
        sides = (members.select(F.col("grp").alias(f"g{c}"), F.col("cls").alias(c), F.col("root").alias(f"r{c}"))
                 for c in "ab")
        pairs = group_pairs.join(next(sides), "ga").join(next(sides), "gb").where("a <> b and ra <> rb")
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def verified(class_pairs: DataFrame, name: str) -> DataFrame:
        pairs = stored(_close(class_pairs, classes, rule), f"jaccard-{name}-pairs")
        ends = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
        texts = stored(_texts(docs, classes.join(ends, "cls", "left_semi"), doc_id, text), f"jaccard-{name}-texts")
        links = stored(_verified(pairs, texts, rule), f"jaccard-{name}-links")
        dropped(pairs, texts)
        return links

    def merged(members: DataFrame, links: DataFrame) -> DataFrame:
        """The classes with the roots that further links between their components give."""
        ends = members.select("cls", "root")
        pairs = links.join(ends.select(F.col("cls").alias("a"), F.col("root").alias("ra")), "a") \
            .join(ends.select(F.col("cls").alias("b"), F.col("root").alias("rb")), "b")
        found = components(pairs, "ra", "rb").select(F.col("node").alias("root"), F.col("root").alias("top"))
        return members.join(found, "root", "left").withColumn("root", F.coalesce("top", "root")).drop("top")

    # round one: neighbours in the lists, and in a group each class with the first
    alone = classes.drop("bitmap", "rep").withColumn("root", F.col("cls"))
    first = classes.groupBy("grp").agg(F.min("cls").alias("a"), F.count("*").alias("m")).where("m > 1")
    inside = classes.join(first, "grp").where("cls <> a").select("a", F.col("cls").alias("b"))
    near = verified(expanded(_neighbour_pairs(lists, rule), alone).unionByName(inside).distinct(), "near")

    def sided(members: DataFrame) -> DataFrame:
        """(grp, side, fold1, fold2, split) of the groups; one in several components is split and a side of its own."""
        groups = members.groupBy("grp").agg(
            (F.min("root") != F.max("root")).alias("split"), F.min("root").alias("root"), F.count("*").alias("m"),
            *[F.min(f).alias(f) for f in ("fold1", "fold2")])
        return stored(groups.select(
            "grp", F.when(F.col("split"), F.col("grp").cast("string").cast("binary")).otherwise(F.col("root")).alias("side"),
            *[F.when(F.col("m") == 1, F.col(f)).alias(f) for f in ("fold1", "fold2")], "split"), "jaccard-groups")

    # round two: more neighbours, in other components
    alone = stored(merged(alone, near), "jaccard-members")
    groups = sided(alone)
    mixed = stored(_mixed_lists(lists, groups.drop("split")), "jaccard-mixed")
    more = verified(expanded(_window_pairs(mixed, rule), alone), "window")
    # round three: whatever is still apart
    members = stored(merged(alone, more), "jaccard-members")
    last = sided(members)
    split = last.where("split").select(F.col("grp").alias("ga"), F.col("grp").alias("gb"))
    crossing = _cross_pairs(mixed.select("token", "place", "grp"), last.drop("split"), rule)
    cross = verified(expanded(crossing.union(split), members), "cross")
    rooted = stored(merged(members, cross), "jaccard-members")
    dropped(classes, lists, near, alone, groups, mixed, more, members, last, cross)
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.sum("copies").alias("m")) \
        .where("m > 1")
    shared = rooted.join(least, "root").select("cls", "component_id", "root")
    return rows.select("doc_id", "n_shingles", "cls", "text_hash").join(shared, "cls", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("root", "cls").alias("root"), "text_hash")


def one_of_each(docs: DataFrame, rule: Rule, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with one row of each component: that of the least doc_id (then text
    hash). Rows with an empty set all stay. Only rows in components of several rows,
    and a few that a Bloom filter lets pass, are shuffled."""
    rows = stored(jaccard_components(docs, rule, doc_id, text).where("root is not null").select(
        "root", F.struct("doc_id", "text_hash").alias("row")), "jaccard-rows")
    groups = rows.groupBy("root").agg(F.min("row").alias("keeper"), F.count("*").alias("m")).where("m > 1")
    members = stored(rows.join(groups, "root").select(
        F.xxhash64("row.doc_id", "row.text_hash").alias("__key"), (F.col("row") == F.col("keeper")).alias("__stays"))
        .groupBy("__key").agg(F.max("__stays").alias("__stays")), "jaccard-members")
    dropped(rows)
    keyed = docs.withColumn("__key", F.xxhash64(F.col(doc_id), _text_hash(text)))
    probe = may_contain(keyed, "__key", blocked_bloom(members, "__key", members.count()), "__asked")
    asked = probe.where("__asked").join(members, "__key", "left")
    keepers = asked.where("__stays").dropDuplicates(["__key"]).select(*docs.columns)
    return probe.where("not __asked").select(*docs.columns) \
        .unionByName(asked.where("__stays is null").select(*docs.columns)).unionByName(keepers)
