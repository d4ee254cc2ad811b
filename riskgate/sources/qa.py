"""Question/answer file sources.

Each reader takes a path (JSON lines, a multi-line JSON document or Parquet)
with an explicit schema and returns a sample table:
``sample_id long, text string, entities array<string>, true_label int,
true_severity double, source string``. The per-row work is the same column
expressions used everywhere else; the "first n" of a source is an explicit
ordered limit on a key, because Spark rows have no inherent order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from riskgate import fixed
from riskgate.functions import options
from riskgate.functions import text as T
from riskgate.operators.joins import risk_lookup

SAMPLE_COLUMNS = ["sample_id", "text", "entities", "true_label", "true_severity", "source"]

OPTION_MAP_SCHEMA = T_.StructType([
    T_.StructField("sample_id", T_.LongType()),
    T_.StructField("question", T_.StringType()),
    T_.StructField("options", T_.ArrayType(T_.StructType([
        T_.StructField("key", T_.StringType()), T_.StructField("value", T_.StringType())]))),
    T_.StructField("answer_idx", T_.StringType()),
])

OPTION_COLUMN_SCHEMA = T_.StructType([
    T_.StructField("sample_id", T_.LongType()),
    T_.StructField("question", T_.StringType()),
    *[T_.StructField(c, T_.StringType()) for c in ("opa", "opb", "opc", "opd")],
    T_.StructField("cop", T_.IntegerType()),
    T_.StructField("subject_name", T_.StringType()),
    T_.StructField("exp", T_.StringType()),
])

REFERENCE_SCHEMA = T_.StructType([
    T_.StructField("sample_id", T_.LongType()),
    T_.StructField("category", T_.StringType()),
    T_.StructField("question", T_.StringType()),
    T_.StructField("best_answer", T_.StringType()),
    T_.StructField("incorrect_answers", T_.ArrayType(T_.StringType())),
])

RESPONSE_SCHEMA = T_.StructType([
    T_.StructField("id", T_.StringType()),
    T_.StructField("category", T_.StringType()),
    T_.StructField("model", T_.StringType()),
    T_.StructField("question", T_.StringType()),
    T_.StructField("response", T_.StringType()),
    T_.StructField("_correct_answer_hint", T_.StringType()),
])

RESPONSE_FILE_SCHEMA = T_.StructType([
    T_.StructField("_instructions", T_.ArrayType(T_.StringType())),
    T_.StructField("responses", T_.ArrayType(RESPONSE_SCHEMA)),
])

BANK_SCHEMA = T_.StructType([
    T_.StructField("id", T_.StringType()),
    T_.StructField("category", T_.StringType()),
    T_.StructField("risk_level", T_.IntegerType()),
    T_.StructField("question", T_.StringType()),
    T_.StructField("correct_answer", T_.StringType()),
    T_.StructField("key_facts", T_.ArrayType(T_.StringType())),
    T_.StructField("red_flags", T_.ArrayType(T_.StringType())),
    T_.StructField("entities", T_.ArrayType(T_.StringType())),
])

# The second bank spelling: risk / correct_facts, no correct_answer.
BANK_RENAMES = {"risk": "risk_level", "correct_facts": "key_facts"}
# What is read: both spellings at once, so that no pass over the files infers types.
BANK_FILE_SCHEMA = T_.StructType([*BANK_SCHEMA.fields, *[
    T_.StructField(src, BANK_SCHEMA[dst].dataType) for src, dst in BANK_RENAMES.items()]])


def _read(spark: SparkSession, path: str | Sequence[str], schema, fmt: str = "json",
          multiline: bool = False) -> DataFrame:
    r = spark.read.schema(schema)
    if fmt == "json":
        return r.option("multiLine", multiline).json(path)
    return r.format(fmt).load(path)


def option_map_file(spark: SparkSession, path: str | Sequence[str], multiline: bool = False) -> DataFrame:
    """Option-map records (S1) as they are published: ``options`` is an object from
    letter to text, in the order of the file, or already a list of key/value pairs."""
    fields = [f if f.name != "options" else T_.StructField("options", T_.StringType()) for f in OPTION_MAP_SCHEMA.fields]
    raw = _read(spark, path, T_.StructType(fields), multiline=multiline)
    pairs = OPTION_MAP_SCHEMA["options"].dataType
    listed = F.from_json("options", pairs.simpleString())
    mapped = F.map_entries(F.from_json("options", "map<string,string>"))
    return raw.withColumn("options", F.when(F.ltrim("options").startswith("["), listed).otherwise(mapped).cast(pairs))


def keyed(df: DataFrame) -> DataFrame:
    """Rows with a key: their ``sample_id``, or where there is none a hash of the
    record, so that labels and severities are drawn record by record."""
    columns = [c for c in df.columns if c != "sample_id"]
    derived = F.xxhash64(F.to_json(F.struct(*columns)))
    own = F.col("sample_id") if "sample_id" in df.columns else F.lit(None).cast("long")
    return df.withColumn("sample_id", F.coalesce(own, derived))


def _first_n(df: DataFrame, n: int | None, key: str = "sample_id") -> DataFrame:
    return df if n is None else df.orderBy(key).limit(n)


def _finish(df: DataFrame, output_col, label_col, severity_col, source_col) -> DataFrame:
    return df.select(
        "sample_id", T.prompt_text("question", output_col).alias("text"),
        T.extract_terms(F.concat_ws(" ", F.col("question"), output_col)).alias("entities"),
        label_col.alias("true_label"), severity_col.alias("true_severity"), source_col.alias("source"))


def option_map_source(df: DataFrame, n: int | None = None, rate: float = fixed.HALLUCINATION_RATE,
                      seed: int = 42, source: str = fixed.SOURCE_TAG_OPTION_MAP) -> DataFrame:
    """Keyed-options QA rows to samples (S1): the first ``n`` by sample_id."""
    d = _first_n(keyed(df), n)
    key = F.col("sample_id")
    drawn = options.corrupted(seed, key, rate)
    right = options.right_by_key("options", "answer_idx")
    wrong = options.first_wrong_by_key("options", "answer_idx")
    d = d.withColumn("_out", options.pick_output(drawn, wrong, right)) \
         .withColumn("_lab", options.used_wrong(drawn, wrong))
    sev = options.severity_fixed_range("_lab", seed, key, fixed.SEVERITY_OPTION_MAP)
    return _finish(d, F.col("_out"), F.col("_lab"), sev, F.lit(source))


def option_column_source(df: DataFrame, n: int | None = None, rate: float = fixed.HALLUCINATION_RATE,
                         seed: int = 42, subject_risk: Mapping[str, int] = fixed.SUBJECT_RISK) -> DataFrame:
    """Four-option-column QA rows to samples (S2): risk by subject (J2), the
    subject appended as a term (P8), source tag by subject (P7)."""
    d = _first_n(keyed(df), n).withColumn("subject_name",
                                          F.coalesce(F.col("subject_name"), F.lit(fixed.DEFAULT_SUBJECT)))
    d = risk_lookup(d, "subject_name", subject_risk, out_col="base_risk")
    key = F.col("sample_id")
    opts = F.array("opa", "opb", "opc", "opd")
    drawn = options.corrupted(seed, key, rate)
    right = options.right_by_index(opts, "cop")
    wrong = options.first_wrong_by_index(opts, "cop")
    d = d.withColumn("_out", options.pick_output(drawn, wrong, right)) \
         .withColumn("_lab", options.used_wrong(drawn, wrong))
    sev = options.severity_by_risk("_lab", "base_risk", seed, key)
    out = d.select("sample_id", "subject_name", "question", "_out", "_lab", sev.alias("_sev"))
    return out.select(
        "sample_id", T.prompt_text("question", "_out").alias("text"),
        T.append_term(T.extract_terms(F.concat_ws(" ", "question", "_out")), F.col("subject_name"))
        .alias("entities"),
        F.col("_lab").alias("true_label"), F.col("_sev").alias("true_severity"),
        T.source_tag(fixed.SOURCE_TAG_OPTION_COLUMNS_PREFIX, F.col("subject_name")).alias("source"))


def reference_answer_source(df: DataFrame, n: int | None = None,
                            words: Sequence[str] = fixed.MEDICAL_CATEGORY_WORDS,
                            rate: float = fixed.HALLUCINATION_RATE, seed: int = 42,
                            source: str = fixed.SOURCE_TAG_REFERENCE) -> DataFrame:
    """Reference-answer QA rows to samples (S3): category filter by substring
    (F1), then the first ``n`` (F4); wrong answer = first incorrect one."""
    arr = F.array(*[F.lit(w) for w in words])
    cat = F.coalesce(F.col("category"), F.lit(""))
    d = _first_n(keyed(df).filter(F.exists(arr, lambda w: F.contains(cat, w))), n)
    key = F.col("sample_id")
    drawn = options.corrupted(seed, key, rate)
    wrong = F.coalesce(F.try_element_at(F.col("incorrect_answers"), F.lit(1)),
                       F.lit(fixed.MISSING_REFERENCE_ANSWER))
    out = F.when(drawn, wrong).otherwise(F.col("best_answer"))
    d = d.withColumn("_out", out).withColumn("_lab", drawn.cast("int"))
    sev = options.severity_fixed_range("_lab", seed, key, fixed.SEVERITY_REFERENCE)
    return _finish(d, F.col("_out"), F.col("_lab"), sev, F.lit(source))


def combined(sources: Mapping[str, DataFrame]) -> DataFrame:
    """Union of named sample tables (S5, U1). Unknown names are the caller's
    concern: only the frames given are read. Duplicates are kept."""
    out = None
    for _, df in sources.items():
        df = df.select(*SAMPLE_COLUMNS)
        out = df if out is None else out.unionByName(df)
    return out


def combine_sources(names: Sequence[str], loaders: Mapping, seed: int = 42, n_each: int | None = None) -> DataFrame:
    """Dispatch by source name, the first ``n_each`` rows by key of each, union, seeded
    shuffle key (S5, F4, O3).

    ``loaders`` maps a name to a callable ``seed -> DataFrame`` of sample rows;
    the seed reaches every loader (fixes D9). An unknown name is warned about
    and skipped. ``shuffle_key`` orders rows deterministically for a later
    limit; the rows themselves are not moved.
    """
    import warnings

    from riskgate.operators.split import seeded_shuffle
    frames = {}
    for name in names:
        if name not in loaders:
            warnings.warn(f"Unknown source '{name}', skipping.")
            continue
        frames[name] = _first_n(loaders[name](seed), n_each)
    if not frames:
        raise ValueError("No known source among " + ", ".join(names))
    u = combined(frames)
    k = F.concat_ws(":", F.col("source"), F.col("sample_id").cast("string"))
    return seeded_shuffle(u.withColumn("_k", k), "_k", seed).drop("_k")


def response_file(spark: SparkSession, path: str | Sequence[str], only_filled: bool = True,
                  lines: bool = False) -> DataFrame:
    """Responses from one or more files (S6, U2: a list or glob of per-model files).
    A record may be a response or a document that holds a list of them, mixed as
    they come; ``lines`` says that each line is a record (as ``write_template`` and
    ``write_template_documents`` write them), else a file is one. Placeholder, empty
    and null responses are dropped (F2)."""
    from riskgate.functions.judge import is_filled
    schema = T_.StructType([*RESPONSE_SCHEMA.fields, *RESPONSE_FILE_SCHEMA.fields])
    names = RESPONSE_SCHEMA.fieldNames()
    raw = _read(spark, path, schema, multiline=not lines)
    alone = F.array(F.struct(*names)).cast(T_.ArrayType(RESPONSE_SCHEMA))
    r = raw.select(F.explode(F.coalesce("responses", alone)).alias("r")).select("r.*")
    return r.filter(is_filled("response")) if only_filled else r


def response_records(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Line records of response files with the file they come from (S6, U2): the columns of a
    response, ``source_file``, and ``bad_record``, which holds the text of a line that is
    no record and is null otherwise. Nothing is dropped: filter ``bad_record is null``, and
    report the rest."""
    names = RESPONSE_SCHEMA.fieldNames()
    schema = T_.StructType([*RESPONSE_SCHEMA.fields, *RESPONSE_FILE_SCHEMA.fields, T_.StructField("bad_record", T_.StringType())])
    raw = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad_record").json(path) \
        .select("*", F.col("_metadata.file_path").alias("source_file"))
    alone = F.array(F.struct(*names)).cast(T_.ArrayType(RESPONSE_SCHEMA))
    return raw.select(F.explode(F.coalesce("responses", alone)).alias("r"), "source_file", "bad_record") \
        .select("r.*", "source_file", "bad_record")


def bank_source(spark: SparkSession, path: str | Sequence[str], multiline: bool = False) -> DataFrame:
    """A question bank file (S7) in either spelling; where both are set the first
    (risk_level, key_facts) counts, missing columns are null."""
    raw = _read(spark, path, BANK_FILE_SCHEMA, multiline=multiline)
    for src, dst in BANK_RENAMES.items():
        raw = raw.withColumn(dst, F.coalesce(dst, src))
    return raw.select(*BANK_SCHEMA.fieldNames())
