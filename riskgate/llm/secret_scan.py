"""Secret scans with DataFrame functions only.

Base rules find assignments (`token = "..."`), access key ids and hex runs. The method
adds other random-looking tokens: runs of 20 or more letters, digits and `+ / _ -` that
no base span overlaps, with a digit and a letter. For each the encoding is inferred
(hex, base32, base36, base62 or base64; of several the smallest whose
classes of symbols the token uses) and a battery tests whether its symbols could be drawn
at random from that alphabet: chi-squared uniformity, runs above and below the
alphabet's middle, and lag-one serial correlation, combined by Bonferroni. Tokens of
ordinary text fail the battery; a token that it can't reject is reported.

Rejections are controlled for false discovery, by length: within each power-of-two
length class the p-values of all tokens of the table are counted in logarithmic bins,
and the Benjamini-Hochberg rule sets the class's cut-off. Short tokens carry less
evidence, so their level is higher. The counts that reach the driver are at most
LENGTH_CLASSES x BINS rows.

Positions count code points, ends are exclusive. Defined results: a null text counts as
empty and has no spans; overlapping base spans of different kinds all stay; repeated
rows are scanned alike (and count each in the false-discovery counts); other input
columns are not read unless named in `carry`; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


# Fixed values of the base rules.
_KEY = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token")) + \
    f"|{_either_case('api')}_?{_either_case('key')}"
ASSIGN = rf"""({_KEY})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
MIN_ASSIGNED = 6
#: A shorter run that starts with AKIA, or of hex digits, can't contain a longer one, so the lengths are in the patterns.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
MIN_TOKEN = 20
LENGTH_CLASSES = 13
BINS = 80
BINS_PER_DECADE = 4

HEX_LOWER, HEX_UPPER = "0123456789abcdef", "0123456789ABCDEF"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE32_LOWER = "abcdefghijklmnopqrstuvwxyz234567"
BASE36, BASE36_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789"
BASE62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
BASE64 = BASE62 + "+/"

MARK = "[SECRET]"

#: Elements of a block of an array, and code points of a piece of a text.
BLOCK, PIECE = 128, 1024


def _matches(text: str, pattern: str) -> Column:
    return F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))


def _bound(x: Column, f) -> Column:
    """f(x) with x computed once: a column used in a lambda is computed for every element."""
    return F.transform(F.array(x), f)[0]


def _in_blocks(items: Column, f) -> Column:
    """[f(block)] over the array's blocks of BLOCK elements; empty for an empty array. What
    grows by a copy at each step stays within a block, so long arrays cost a fixed
    multiple of their length."""
    count = F.when(F.size(items) > 0, F.floor((F.size(items) - 1) / BLOCK).cast("int"))
    whole = F.transform(F.sequence(F.lit(0), count), lambda k: f(F.slice(items, k * BLOCK + 1, F.lit(BLOCK))))
    return F.coalesce(whole, F.array())


def _handed_on(blocks: Column, first: Column, add) -> Column:
    """What each block starts from: `first`, then add(that, block) of the one before."""
    def step(acc, block):
        return F.struct(add(acc["at"], block).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    none = F.array().cast("array<bigint>")
    return F.aggregate(blocks, F.struct(first.alias("at"), none.alias("out")), step, lambda acc: acc["out"])


_SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string,found:string>>"


def _spans(text: str, pattern: str, matches: str, kind: str, keep) -> Column:
    """The kept matches as (start, rank, end, kind): the text between matches is what
    splitting by the pattern leaves, so lengths add up to positions."""
    none = F.array().cast(_SPAN)
    zero = F.lit(0).cast("bigint")
    gaps = F.split(F.col(text), pattern, -1)
    steps = F.zip_with(F.slice(gaps, 1, F.size(matches)), F.col(matches), lambda g, m: F.struct(
        F.char_length(g).cast("bigint").alias("gap"), m.alias("found")))

    def span(start, x):
        return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"),
                        (start + F.char_length(x["found"])).alias("end"), F.lit(kind).alias("kind"), x["found"].alias("found"))

    def step(acc, x):
        start = acc["at"] + x["gap"]
        return F.struct((start + F.char_length(x["found"])).alias("at"), F.concat(acc["out"], F.array(span(start, x))).alias("out"))

    def placed(blocks):
        moved = F.zip_with(blocks, _handed_on(blocks, zero, lambda at, block: at + block["at"]), lambda block, at: F.transform(
            block["out"], lambda x: span(at + x["start"], x)))
        return F.flatten(moved)

    first = F.struct(zero.alias("at"), none.alias("out"))
    found = _bound(steps, lambda all_: _bound(_in_blocks(all_, lambda block: F.aggregate(block, first, step)), placed))
    return F.when(F.size(matches) == 0, none).otherwise(F.filter(found, lambda x: keep(x["found"])))


def _free(tokens: str, base: str) -> Column:
    """The tokens that no base span overlaps: a block of them is held against the base spans
    of its own stretch of the text only."""
    def within(both):
        def block_free(block):
            near = F.filter(both["base"], lambda b: (b["start"] < F.element_at(block, -1)["end"]) & (F.element_at(block, 1)["start"] < b["end"]))
            return _bound(near, lambda close: F.filter(block, lambda t: ~F.exists(
                close, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))))
        return F.flatten(_in_blocks(both["tokens"], lambda block: _bound(block, block_free)))

    inner = _bound(F.struct(F.col(tokens).alias("tokens"), F.col(base).alias("base")), within)
    return F.when((F.size(tokens) == 0) | (F.size(base) == 0), F.col(tokens)).otherwise(inner)


# -- the battery ----------------------------------------------------------------

def _upper_tail(z: Column) -> Column:
    """P(N > z) of the standard normal (Abramowitz and Stegun 26.2.17)."""
    t = F.lit(1.0) / (F.lit(1.0) + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = poly * F.exp(-z * z / 2) * 0.3989422804014327
    return F.when(z >= 0, tail).otherwise(F.lit(1.0) - tail)


def alphabet(token: Column) -> Column:
    """The symbols of the encoding that a token seems to have."""
    return F.when(token.rlike("^[0-9a-f]+$"), HEX_LOWER).when(token.rlike("^[0-9A-F]+$"), HEX_UPPER) \
        .when(token.rlike("^[A-Z2-7]+$"), BASE32).when(token.rlike("^[a-z2-7]+$"), BASE32_LOWER) \
        .when(token.rlike("^[A-Z0-9]+$"), BASE36).when(token.rlike("^[a-z0-9]+$"), BASE36_LOWER) \
        .when(token.rlike("^[A-Za-z0-9]+$"), BASE62).otherwise(BASE64)


def battery(token: Column) -> Column:
    """Combined p-value of the hypothesis that the token's symbols are random."""
    def tests(s):
        n, size = s["n"], s["size"]
        k = size - 1
        chi = size * s["squares"] / n - n
        z1 = (F.pow(chi / k, F.lit(1 / 3)) - (1 - F.lit(2.0) / (9 * k))) / F.sqrt(F.lit(2.0) / (9 * k))
        z2 = (s["changes"] - (n - 1) / 2) / (F.sqrt(n - 1) / 2)
        z3 = s["products"] / s["power"] * F.sqrt(n)
        return F.least(F.lit(1.0), 3 * F.least(_upper_tail(z1), 2 * _upper_tail(F.abs(z2)), 2 * _upper_tail(F.abs(z3))))

    def sums(s):
        steps = F.zip_with(F.slice(s["v"], 1, F.size(s["v"]) - 1), F.slice(s["v"], 2, F.size(s["v"]) - 1),
                           lambda a, b: F.struct((a * b).alias("p"), ((a > 0) != (b > 0)).alias("c")))
        zero = F.lit(0.0)
        return F.struct(
            F.size(s["v"]).cast("double").alias("n"), F.char_length(s["letters"]).cast("double").alias("size"),
            F.aggregate(s["counts"], zero, lambda a, c: a + c * c).alias("squares"),
            F.aggregate(steps, zero, lambda a, x: a + x["p"]).alias("products"),
            F.aggregate(steps, zero, lambda a, x: a + F.when(x["c"], 1.0).otherwise(0.0)).alias("changes"),
            F.aggregate(s["v"], zero, lambda a, x: a + x * x).alias("power"))

    def symbols(s):
        middle = (F.char_length(s["letters"]) + 1) / 2
        return F.struct(
            s["letters"].alias("letters"),
            F.transform(F.split(s["token"], ""), lambda c: F.instr(s["letters"], c) - middle).alias("v"),
            F.transform(F.split(s["letters"], ""), lambda c: (
                F.char_length(s["token"]) - F.char_length(F.replace(s["token"], c, F.lit("")))).cast("double")).alias("counts"))

    named = F.struct(F.translate(token, "-_", "+/").alias("token"), alphabet(F.translate(token, "-_", "+/")).alias("letters"))
    return _bound(_bound(_bound(named, symbols), sums), tests)


def _length_class(n: Column) -> Column:
    return F.least(F.floor(F.log2(n)).cast("int"), F.lit(3 + LENGTH_CLASSES))


def _bin(p: Column) -> Column:
    """Bins of falling p-values: bin b holds p <= 10 ** (-b / BINS_PER_DECADE)."""
    return F.least(F.lit(BINS), F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * BINS_PER_DECADE).cast("int"))


def level(length_class: int) -> float:
    """False-discovery level of a length class."""
    return 0.2 if length_class < 5 else 0.1 if length_class < 6 else 0.05


def cut_offs(counts: dict[tuple[int, int], int]) -> dict[int, int]:
    """Benjamini-Hochberg on binned p-values: per length class the first bin whose tokens
    are rejected (BINS + 1: none), from (class, bin) -> tokens."""
    found = {}
    for c in {k for k, _ in counts}:
        total, below = sum(n for (k, _), n in counts.items() if k == c), 0
        found[c] = BINS + 1
        for b in range(BINS, -1, -1):
            below += counts.get((c, b), 0)
            if below and 10 ** (-b / BINS_PER_DECADE) <= level(c) * below / total:
                found[c] = b
    return found


# -- scans -----------------------------------------------------------------------

def _scanned(docs: DataFrame, carry: tuple[str, ...], text: str) -> DataFrame:
    """carry, text, base spans and the tokens left to the battery, each with its bin."""
    names = [f"__c{i}" for i in range(len(carry))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(carry, names, strict=True)],
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("*", _matches("text", ASSIGN).alias("m_assign"), _matches("text", ACCESS).alias("m_access"),
                       _matches("text", HEX).alias("m_hex"), _matches("text", TOKEN).alias("m_random"))
    rows = rows.select(
        *names, "text",
        _spans("text", ASSIGN, "m_assign", "assign",
               lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= MIN_ASSIGNED).alias("assign"),
        _spans("text", ACCESS, "m_access", "access", lambda m: F.lit(True)).alias("access"),
        _spans("text", HEX, "m_hex", "hex", lambda m: F.lit(True)).alias("hex"),
        _spans("text", TOKEN, "m_random", "random", lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]")).alias("tokens"))
    rows = rows.withColumn("base", F.sort_array(F.concat("assign", "access", "hex")))
    judged = F.transform(_free("tokens", "base"), lambda t: F.struct(
        t.alias("span"), _length_class(F.char_length(t["found"])).alias("cls"), _bin(battery(t["found"])).alias("bin")))
    return rows.withColumn("judged", judged)


def secret_spans(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Per row: the carried columns, the text, `base` and `spans`: arrays of (start,
    rank, end, kind, found), by start and then kind."""
    rows = _scanned(docs, carry, text)
    binned = rows.select(F.explode("judged").alias("j")).groupBy("j.cls", "j.bin").agg(F.count("*").alias("n")).collect()
    first = cut_offs({(r["cls"], r["bin"]): r["n"] for r in binned})
    bound = F.create_map(*[x for c, b in sorted(first.items()) for x in (F.lit(c), F.lit(b))]) if first else None
    random = F.filter("judged", lambda j: j["bin"] < bound[j["cls"]]) if first else F.col("judged")
    spans = F.sort_array(F.concat("base", F.transform(random, lambda j: j["span"])))
    names = [F.col(f"__c{i}").alias(c) for i, c in enumerate(carry)]
    return rows.select(*names, F.col("text").alias("__text"), "base", spans.alias("spans"))


def of_kind(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def written(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: str, spans: str) -> Column:
    """The text with every span, or run of overlapping spans, replaced by MARK. What is kept
    is cut from pieces of the text, so no cut reads it from the beginning."""
    zero, none = F.lit(0).cast("bigint"), F.array().cast("array<struct<from:bigint,to:bigint>>")

    def step(acc, x):
        gap = F.array(F.struct(acc["at"].alias("from"), x["start"].alias("to")))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"),
                        F.when(x["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], gap)).alias("out"))

    def last(block):
        return F.array_max(F.transform(block, lambda x: x["end"]))

    def gaps(blocks):
        begun = _handed_on(blocks, zero, lambda at, block: F.greatest(at, last(block)))
        return F.flatten(F.zip_with(blocks, begun, lambda block, at: F.aggregate(
            block, F.struct(at.alias("at"), none.alias("out")), step, lambda acc: acc["out"])))

    def kept(x):
        def cut(start, end):
            first = F.floor(start / PIECE).cast("int")
            some = F.slice(x["pieces"], first + 1, F.floor((end - 1) / PIECE).cast("int") - first + 1)
            return F.when(end > start, F.substring(F.array_join(some, ""), (start - first * PIECE + 1).cast("int"), (end - start).cast("int"))) \
                .otherwise("")
        marked = F.transform(x["gaps"], lambda g: F.concat(cut(g["from"], g["to"]), F.lit(MARK)))
        return F.concat(F.array_join(marked, ""), cut(x["end"], x["length"]))

    whole = F.struct(F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("pieces"),
                     _bound(_in_blocks(F.col(spans), lambda block: block), gaps).alias("gaps"), last(F.col(spans)).alias("end"),
                     F.char_length(text).cast("bigint").alias("length"))
    return F.when(F.size(spans) == 0, F.col(text)).otherwise(_bound(whole, kept))
