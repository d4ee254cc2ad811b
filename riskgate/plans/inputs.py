"""Inputs the registered queries derive from the supplied tables.

The supplied tables carry no question banks, model names or probe outputs, so
these are derived by fixed rules (stated once here and mirrored in the oracle
SQL): a fact bank from ``benchmark`` texts, responses from assistant turns of
``conversations``, and index components from features of the whole text through
given linear probes and class weights. Labels never enter a score. Every derived
input grows with its table; nothing is capped or sampled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgate import fixed
from riskgate.functions import draws, scoring
from riskgate.functions import text as T
from riskgate.operators import features as features_ops

SEED = 42
# Responses are assigned to questions by conv_id modulo six fifths of the bank's rows,
# so that every bank row is asked and some responses match none.
SLOTS_PER_ROW = (6, 5)
# More models than this is an error; none is left out.
MAX_MODELS = 10_000
# Given probes over the five text features: (bias, weights) of the uncertainty and the
# violation probe, and of each risk class.
UNCERTAINTY_PROBE = (-0.5, [4.0, 1.5, 1.0, 6.0, 0.5])
VIOLATION_PROBE = (0.3, [-3.0, 2.0, 1.5, 8.0, -0.4])
RISK_PROBES = [(0.2, [1.0, 0.5, -1.0, -2.0, 0.3]), (0.0, [0.0, 1.0, 0.5, 1.0, 0.2]), (0.3, [-1.0, 0.2, 0.6, 2.0, 0.1]),
               (-0.2, [0.5, -0.5, 1.0, 4.0, 0.4]), (-0.4, [2.0, -1.0, 0.2, 6.0, 0.6])]
SYMBOLS = "#!|&%$*"
# Bank phrase rules over the whole item text (lower-cased letter-only words):
# facts are the 4-5 letter words, red flags the 6-7 letter words. On the
# supplied corpus this mix exercises every judge branch (flag hits, high flag
# rate, low coverage, clean answers).
FACT_LENGTHS = (4, 5)
FLAG_LENGTHS = (6, 7)
# Vocabulary of frequent corpus words for the vocabulary branch of extraction.
CORPUS_VOCABULARY = ["the", "and", "with", "that", "de", "la", "le", "des",
                     "die", "und", "der", "que", "el", "los"]
# Risk per document source; sources not listed take the default 3.
SOURCE_RISK = {"src0": 4, "src1": 5, "src2": 3, "src3": 2, "src4": 1,
               "src5": 4, "src6": 5, "src7": 2}
# Category words of the substring filter on part types.
PART_TYPE_WORDS = ["MALL", "PROMO", "Medicine"]


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """Read a supplied table. ``spread`` is for CPU-heavy per-row work (whole-
    text extraction, judging): when the scan yields fewer partitions than the
    session's parallelism (a single-row-group file is read by one task),
    the rows are dealt round-robin over that many tasks. On large inputs the scan
    already has thousands of splits and nothing is added."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if spread:
        df = spread_rows(df)
    return df


# A scan of more splits than this is never shuffled to even out its tasks.
MAX_SPREAD_SPLITS = 32


def spread_rows(df: DataFrame) -> DataFrame:
    """Round-robin over two partitions per core, which evens out rows of very different
    length (1 to 20,000 words), only where the scan has few splits (a single-row-group
    file is read by one task): at most MAX_SPREAD_SPLITS splits are ever moved."""
    target = 2 * df.sparkSession.sparkContext.defaultParallelism
    few = df.rdd.getNumPartitions() < min(2 * target, MAX_SPREAD_SPLITS + 1)
    return df.repartition(target) if few else df


def lower_words(text_col) -> F.Column:
    """Lower-cased letter-only words of the whole text."""
    ws = F.transform(T.words(text_col), lambda w: F.lower(F.trim(w, F.lit(fixed.TERM_STRIP_CHARS))))
    return F.filter(ws, lambda w: w.rlike(r"^\p{L}+$"))


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact bank: one question per benchmark item (id = item_id)."""
    b = table(spark, sf_dir, "benchmark")
    w = lower_words(F.col("text"))
    lo, hi = FACT_LENGTHS
    return b.select(
        F.col("item_id").alias("id"),
        F.col("text").alias("question"),
        (F.pmod(F.col("item_id"), F.lit(3)) + 3).cast("int").alias("risk_level"),
        F.array_distinct(F.filter(w, lambda x: F.length(x).between(lo, hi))).alias("key_facts"),
        F.array_distinct(F.filter(w, lambda x: F.length(x).between(*FLAG_LENGTHS))).alias("red_flags"),
        T.extract_terms(F.col("text")).alias("entities"),
    )


def question_slots(spark: SparkSession, sf_dir: str) -> int:
    """Number of question ids that responses are dealt to (one count of the bank)."""
    more, per = SLOTS_PER_ROW
    return max(1, table(spark, sf_dir, "benchmark").count() * more // per)


def question_of(conv: str, slots: int) -> F.Column:
    return F.pmod(F.col(conv), F.lit(slots))


def models(df: DataFrame, model: str = "model") -> list[str]:
    """All models of the data, in order."""
    found = [r[0] for r in df.select(model).distinct().limit(MAX_MODELS + 1).collect()]
    if len(found) > MAX_MODELS:
        raise ValueError(f"more than {MAX_MODELS} models")
    return sorted(m for m in found if m is not None)


def responses(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Assistant turns as responses: question id, model = 'turn<n>'."""
    c = table(spark, sf_dir, "conversations", spread=spread)
    return (c.filter(F.col("role") == "assistant")
             .select("conv_id", "turn",
                     question_of("conv_id", question_slots(spark, sf_dir)).alias("id"),
                     F.concat(F.lit("turn"), F.col("turn").cast("string")).alias("model"),
                     F.col("text").alias("response")))


def text_features(text) -> list[F.Column]:
    """Five numbers of a whole text: shares of spaces, full stops, the letter e and
    symbols, and the logarithm of its length; null counts as empty."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    n = F.char_length(t).cast("double")

    def share(count: F.Column, scale: float) -> F.Column:
        return count.cast("double") * F.lit(scale) / (n + 1.0)

    def times(char: str) -> F.Column:  # an ASCII character is one byte
        return F.octet_length(t) - F.octet_length(F.replace(t, F.lit(char), F.lit("")))

    return [share(times(" "), 1.0), share(times("."), 20.0), share(times("e"), 5.0),
            share(F.regexp_count(t, F.lit(f"[{SYMBOLS}]")), 1.0), F.log(n + 1.0) / 10.0]


def value_features(value: str) -> list[F.Column]:
    """The same five places from a number: fractions, remainders and its logarithm."""
    v = F.coalesce(F.abs(F.col(value)), F.lit(0.0))
    return [v / (v + 100.0), F.pmod(v, F.lit(7.0)) / 7.0, F.pmod(v, F.lit(3.0)) / 3.0, F.pmod(v, F.lit(11.0)) / 22.0,
            F.log(v + 1.0) / 10.0]


def with_components(df: DataFrame, features: list[F.Column]) -> DataFrame:
    """Adds uncertainty, risk_score and violation by the given probes: two logistic
    ones, and the class-weighted risk of five classes. Features and logits are
    columns of their own, so that each is computed once a row."""
    names = [f"_x{k}" for k in range(len(features))]

    def linear(probe) -> F.Column:
        bias, weights = probe
        z = F.lit(bias)
        for w, x in zip(weights, names, strict=True):
            z = z + F.lit(w) * F.col(x)
        return z

    x = df.select("*", *[f.alias(n) for f, n in zip(features, names, strict=True)])
    x = x.select("*", F.array(*[linear(p) for p in RISK_PROBES]).alias("_logits"))
    x = x.select("*", features_ops.softmax("_logits").alias("_classes"))
    return x.select(*df.columns, (1.0 / (1.0 + F.exp(-linear(UNCERTAINTY_PROBE)))).alias("uncertainty"),
                    features_ops.expected_risk("_classes").alias("risk_score"),
                    (1.0 / (1.0 + F.exp(-linear(VIOLATION_PROBE)))).alias("violation"))


def scored(df: DataFrame) -> DataFrame:
    """Adds risk_index and gate from the component columns."""
    return (df.withColumn("risk_index", scoring.risk_index("uncertainty", "risk_score", "violation"))
              .withColumn("gate", scoring.gate("risk_index")))


def scored_documents(spark: SparkSession, sf_dir: str, spread: bool = True) -> DataFrame:
    """Documents with components of their whole text, index and gate; a document is
    flagged when the normalised index passes the threshold; model = source."""
    d = table(spark, sf_dir, "documents", spread=spread)
    base = d.select("doc_id", F.col("source").alias("model"), "text")
    return scored(with_components(base, text_features("text"))).withColumn(
        "is_hallucinated", scoring.predicted_label(scoring.normalised("risk_index")).cast("boolean"))


def labelled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels joined to the scores of their documents: toxic as label, the uncertainty
    (to twelve places, so that equal texts tie) as score, a severity from the labels and a draw, and a
    latency-like duration (n_chars / 1000). Texts are scored before the join, which
    moves numbers only; the label enters no score."""
    lab = table(spark, sf_dir, "labels")
    doc = with_components(table(spark, sf_dir, "documents", spread=True).select("doc_id", "n_chars", "text"),
                          text_features("text")).drop("text")
    out = lab.join(doc, "doc_id", "inner").select(
        "doc_id", "quality", F.col("toxic").alias("true_label"),
        F.round("uncertainty", 12).alias("score"),
        (F.col("toxic") * 15.0 + F.col("quality") * 4.0
         + draws.unit_draw(SEED, F.col("doc_id"), "sev") * 6.0).alias("true_severity"),
        (F.col("n_chars") / 1000.0).alias("latency_ms"), "uncertainty", "risk_score", "violation")
    return scored(out)
