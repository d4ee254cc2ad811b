"""The registered queries of the subpackage against their SQL, and the pipeline against
a brute-force version of its decisions."""

import re

import duckdb
import pytest
import sentencepiece

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from riskgate.llm import quality, sentencepiece_scan
from riskgate.llm.arrow import BATCH_BYTES
from riskgate.llm.queries import QUERIES
from tests.llm.test_small_cases import base_spans, brute_components, edit_distance_inside

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    assert {re.match(r"op(\d+)_", n)[1] for n in QUERIES} == {str(k) for k in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(queries())


def test_pipeline_against_brute_force(spark):
    docs = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    letters = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    kept = []
    for d in docs:
        found = quality.judge((d["text"] or "").encode())
        if found[6]:
            kept.append((d["doc_id"], found[-1]))
    kept = [(i, t) for i, t in kept if (i, i) in {(a, c) for a, _, c in brute_components(kept, corpus_pipeline.NEAR_DUPLICATES)}]
    items = [letters(t) for t in bench]
    grams = [{tuple(w[k:k + 3]) for k in range(len(w) - 2)} for w in items]

    def leaks(text):
        """An item within its edits shares three words in a row with the text."""
        words = letters(text)
        own = {tuple(words[k:k + 3]) for k in range(len(words) - 2)}
        return any(own & g and edit_distance_inside(w, words) <= len(w) // 5 for w, g in zip(items, grams, strict=True))

    kept = [(i, t) for i, t in kept if not leaks(t)]
    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_scan.vocabulary_path("piece_bpe_32k.model"))
    want = {}
    for i, t in kept:
        out, at = [], 0
        for a, _, _, b in base_spans(t):
            if a >= at:
                out += [t[at:a], "[SECRET]"]
            at = max(at, b)
        want[i] = model.encode("".join(out) + t[at:])
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.ids for r in got} == want and len(got) == len(want)
    assert all(r.round_trip for r in got)


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0


@pytest.mark.parametrize("stage", [stage for _, stage in corpus_pipeline.STAGES])
@pytest.mark.parametrize("limit", [None, 1 << 20])
def test_stages_get_texts_in_small_batches(spark, stage, limit):
    """Spark's own limit puts all 40 texts in one batch of 31 MB; a limit that is set stays."""
    from pyspark.sql import functions as F

    def sizes(batches):
        import pyarrow as pa
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    own, key = spark.newSession(), "spark.sql.execution.arrow.maxBytesPerBatch"
    if limit:
        own.conf.set(key, str(limit))
    stage(own, own.read.parquet(f"{SF}/documents.parquet").limit(0), SF)
    texts = own.range(0, 40, 1, 1).select(F.repeat(F.lit("ab "), 1 << 18).alias("text"))
    got = texts.mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(r.n for r in got) == 40
    assert max(r.bytes for r in got) < (limit or BATCH_BYTES) + (1 << 20)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(oracle_sql())))
def test_queries_without_sql_run(spark, name):
    assert queries()[name](spark, SF).count() > 0


def test_language_accuracy_on_held_out_documents(spark):
    from pyspark.sql import functions as F
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = queries()["op6_language_id"](spark, "/root/testdata/sf0.01").where("held_out").join(docs, "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_tables_of_the_sql_are_known():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name in set(QUERIES) & set(oracle_sql()):
        con.execute(f"EXPLAIN {oracle_sql()[name]}")
