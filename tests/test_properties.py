"""Property-based checks on random texts and phrase lists, each batch evaluated in one
Spark job."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from riskgate.functions import judge
from riskgate.functions import text as T

PIECES = ["Metformin", "ASPIRIN", "ecg", "Paris", "PARIS", "paris", "Élodie", "Öl", "Ärzte", "İstanbul",
          "Hba1c", "hba1c", "Beta-blocker", "Covid19", "Word", "Words", "(", ")", "[", "]", ",", ".", ";",
          ":", " ", "  ", "\t", "\n", "\xa0", " ", "　", "\x1c", "\x85", "ǅungla", "Ωmega",
          "ſtrange", "ÀÉÎ", "abc", "Xyzzy", "QRSTu", "x", "ß"]

texts = st.lists(st.sampled_from(PIECES), min_size=0, max_size=40).map("".join)


@settings(max_examples=1, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(texts, min_size=150, max_size=150))
def test_extracted_terms_are_distinct_bounded_and_stable(spark, batch):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(batch)], "i int, t string") \
        .withColumn("terms", T.extract_terms("t"))
    df = df.withColumn("again", T.extract_terms(F.array_join("terms", " "))) \
        .withColumn("spaced", T.extract_terms(F.concat(F.lit(" , "), "t", F.lit(" . "))))
    for r in df.collect():
        assert len(r.terms) <= 10 and len(set(r.terms)) == len(r.terms)
        places = [r.t.find(w) for w in r.terms]
        assert min(places, default=0) >= 0
        assert r.again == r.terms and r.spaced == r.terms


words = st.sampled_from(["oak", "OAK", "willow", "slate", "tile", "", "a", "Moss", "roof"])


@settings(max_examples=1, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.lists(words, max_size=8).map(" ".join), st.lists(words, max_size=5),
                          st.lists(words, max_size=4), st.integers(1, 5)), min_size=100, max_size=100))
def test_judgment_ignores_order_and_case_and_grows_with_flags(spark, batch):
    rows = [(i, t, f, g, r) for i, (t, f, g, r) in enumerate(batch)]
    df = spark.createDataFrame(rows, "i int, t string, f array<string>, g array<string>, r int")
    one = judge.judge_rate("t", "f", "g", "r").alias("j")
    got = df.select(
        one, judge.judge_rate(F.upper("t"), F.reverse("f"), F.reverse("g"), "r").alias("turned"),
        judge.judge_rate("t", "f", F.array().cast("array<string>"), "r").alias("unflagged"),
        judge.judge_rate("t", "f", F.concat("g", "g"), "r").alias("twice")).collect()
    for r in got:
        assert r.turned == r.j
        assert 0.0 <= r.j.severity <= 25.0 and 0.0 <= r.j.fact_coverage <= 1.0
        assert r.unflagged.red_flags_hit == 0 and r.unflagged.facts_found == r.j.facts_found
        assert r.twice.red_flags_hit == 2 * r.j.red_flags_hit and r.twice.severity == r.j.severity
        assert r.j.is_hallucinated or not r.unflagged.is_hallucinated
