"""Cyclic resample source (S4) and union of sources.

Row ``i`` takes bank row ``i mod n_bank`` and suffix ``i mod 6``; the label and
severity are hash draws of (seed, i), so the output is the same however the
index rows are partitioned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgate import fixed
from riskgate.functions import draws, options
from riskgate.functions import text as T


def nation_bank(nation: DataFrame, region: DataFrame) -> DataFrame:
    """A question bank derived from nation/region: which region holds a nation;
    the wrong answer is the next region. ``bank_pos`` = nation key."""
    n_regions = region.count()
    reg = region.select("r_regionkey", "r_name")
    wrong = reg.select(F.col("r_regionkey").alias("_wk"), F.col("r_name").alias("wrong"))
    return (nation.join(reg, nation.n_regionkey == reg.r_regionkey, "inner")
                  .join(wrong, F.pmod(F.col("n_regionkey") + 1, F.lit(n_regions)) == F.col("_wk"), "inner")
                  .select(F.col("n_nationkey").cast("long").alias("bank_pos"),
                          F.concat(F.lit("Which region contains "), F.col("n_name"), F.lit("?")).alias("question"),
                          F.col("r_name").alias("correct"), "wrong",
                          (F.col("n_regionkey") + 1).cast("int").alias("risk"),
                          F.array("n_name", "r_name").alias("entities")))


def cyclic_resample(index: DataFrame, bank: DataFrame, n_bank: int, seed: int = 42,
                    rate: float = fixed.HALLUCINATION_RATE, source: str = fixed.SOURCE_TAG_DEMO,
                    suffixes=fixed.SUFFIX_POOL, i: str = "i") -> DataFrame:
    """Samples for every index row (S4, with P1, P4, P6)."""
    key = F.col(i)
    pool = F.array(*[F.lit(s) for s in suffixes])
    rows = index.select(key, F.pmod(key, F.lit(n_bank)).alias("bank_pos"),
                        F.element_at(pool, (F.pmod(key, F.lit(len(suffixes))) + 1).cast("int")).alias("suffix"),
                        options.corrupted(seed, key, rate).alias("_hal"))
    s = rows.join(bank, "bank_pos", "inner")
    s = s.withColumn("true_label", F.col("_hal").cast("int"))
    return s.select(
        i, "bank_pos", "true_label",
        T.prompt_text("question", F.when(F.col("_hal"), F.col("wrong")).otherwise(F.col("correct")),
                      "suffix").alias("text"),
        "entities",
        options.severity_by_risk("true_label", "risk", seed, key).alias("true_severity"),
        F.lit(source).alias("source"),
    )


def demo_samples(spark: SparkSession, bank: DataFrame, n: int, seed: int = 42,
                 rate: float = fixed.HALLUCINATION_RATE) -> DataFrame:
    """``n`` samples cycled from a bank of (question, correct, wrong, risk,
    entities) rows (S4): row i uses bank row i mod len(bank) (by a
    ``bank_pos`` 0..len-1 column, numbered here if absent) and suffix i mod 6."""
    from pyspark.sql import Window
    if "bank_pos" not in bank.columns:
        # numbering a bank: a global window is fine for a dimension table
        bank = bank.withColumn("bank_pos", (F.row_number().over(Window.orderBy("question")) - 1).cast("long"))
    n_bank = bank.count()
    index = spark.range(n).withColumnRenamed("id", "i")
    return cyclic_resample(index, bank, n_bank, seed=seed, rate=rate)


def union_sources(spark: SparkSession, sf_dir: str, seed: int = 42) -> DataFrame:
    """Documents and assistant turns as one sample table (S5/U1); duplicates kept."""
    from riskgate.plans.inputs import table
    docs = table(spark, sf_dir, "documents").select(
        F.lit("documents").alias("source"), F.col("doc_id").cast("string").alias("key"), "text")
    conv = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant").select(
        F.lit("conversations").alias("source"), F.concat_ws(":", "conv_id", "turn").alias("key"), "text")
    u = docs.unionByName(conv)
    k = F.concat_ws(":", F.col("source"), F.col("key").cast("string"))
    return u.withColumn("true_label", draws.bernoulli(seed, k, "label", fixed.HALLUCINATION_RATE).cast("int"))
