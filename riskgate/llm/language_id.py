"""Language identification by compression.

Per language, a zstandard raw-content dictionary is gathered from a bounded sample of
labelled texts. A text is encoded once with every dictionary; the language whose
dictionary gives the fewest bytes wins. When the runner-up is nearly as short, the
prediction is marked as rejected. Long texts are encoded in blocks, all of them, so
that a dictionary keeps its weight against the text's own repetitions. Texts and dictionaries
are lower-cased first, so that headlines in capitals count as their language.

Learning: at most about SAMPLE_TEXTS distinct texts of each language, chosen by the
hash of the text over all labelled rows, each with one piece of PIECE_CHARS
characters from a hashed place. What reaches the driver is one dictionary of at most
SAMPLE_TEXTS pieces per language; the number of languages is bound by MAX_LANGUAGES
(more is an error, not a cut).

Defined results: a null text, or one without a letter, gets `und` and score 0; equal
sizes go to the language first in order; with no labelled row at all every text gets
`und`; repeated rows are predicted alike. Only the text enters a prediction.
"""

from __future__ import annotations

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from riskgate.llm.arrow import map_texts

SAMPLE_TEXTS = 400
PIECE_CHARS = 256
MAX_LANGUAGES = 500
BLOCK_BYTES = 8192
#: Greedy matching from four bytes on finds the short words that tell languages apart.
MIN_MATCH, SEARCH_LOG, TABLE_LOG, WINDOW_LOG = 4, 2, 16, 18
MIN_MARGIN = 0.01

_LETTER = regex.compile(r"\p{L}")


def learn(labelled: DataFrame, lang: str = "lang", text: str = "text") -> dict[str, bytes]:
    """Dictionary content per language, from rows whose label and text are not null."""
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")) \
        .where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")) \
        .withColumn("h", F.xxhash64("text"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"))
    found = {r["lang"]: r["n"] for r in counts.limit(MAX_LANGUAGES + 1).collect()}
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; raise the bound if that is meant")
    if not found:
        return {}
    share = F.create_map(*[x for k, n in found.items() for x in (F.lit(k), F.lit(SAMPLE_TEXTS / max(1, n)))])
    place = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.lit(1), F.char_length("text") - PIECE_CHARS)).cast("int")
    chosen = rows.where(F.pmod("h", F.lit(1_000_003)) < 1_000_003 * share[F.col("lang")]) \
        .select("lang", "h", F.substring(F.col("text"), place + 1, F.lit(PIECE_CHARS)).alias("piece")) \
        .groupBy("lang", "h").agg(F.min("piece").alias("piece"))
    pieces = chosen.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("h", "piece"))).alias("all"))
    return {r["lang"]: "\n".join(x["piece"] for x in r["all"]).lower().encode() for r in pieces.collect()}


def predictor(dictionaries: dict[str, bytes]):
    """bytes -> (language, score, rejected), with compressors built once."""
    import zstandard as zstd

    settings = zstd.ZstdCompressionParameters(
        compression_level=5, window_log=WINDOW_LOG, strategy=zstd.STRATEGY_GREEDY, min_match=MIN_MATCH,
        search_log=SEARCH_LOG, hash_log=TABLE_LOG, chain_log=TABLE_LOG, write_content_size=False)
    names, encoders = sorted(dictionaries), []
    for name in names:
        raw = zstd.ZstdCompressionDict(dictionaries[name], dict_type=zstd.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(compression_params=settings)
        encoders.append(zstd.ZstdCompressor(compression_params=settings, dict_data=raw))

    def predict(data: bytes | None) -> tuple[str, float, bool]:
        text = (data or b"").decode("utf-8", "replace")
        if not names or not _LETTER.search(text):
            return "und", 0.0, True
        data = text.lower().encode()
        blocks = [data[i:i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
        sizes = sorted((sum(len(e.compress(b)) for b in blocks), n) for e, n in zip(encoders, names, strict=True))
        if len(sizes) == 1:
            return sizes[0][1], 1.0, False
        score = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
        return sizes[0][1], score, score < MIN_MARGIN

    return predict


OUT = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType()),
                  StructField("rejected", BooleanType())])


def predict_language(docs: DataFrame, dictionaries: dict[str, bytes], carry: dict[str, Column],
                     text: str = "text") -> DataFrame:
    """The carried columns, `lang_pred`, `score` (the margin to the runner-up as a share
    of its size, 0 to 1) and `rejected` (margin under MIN_MARGIN)."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # MAX_LANGUAGES x SAMPLE_TEXTS x PIECE_CHARS at most

    def make():
        predict = predictor(shared.value)

        def work(texts):
            rows = [predict(t) for t in texts]
            return {f.name: [r[i] for r in rows] for i, f in enumerate(OUT.fields)}
        return work

    return map_texts(docs, carry, F.col(text), make, OUT)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept out of learning: crc32 of the id as text is a multiple of five."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))
