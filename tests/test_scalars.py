"""Golden values of the scalar functions and vocabularies."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.functions import fts, vocab
from tessera.functions import scalars as S


def values(spark, f, inputs, kind="string"):
    rows = spark.createDataFrame(list(enumerate(inputs)), f"n int, v {kind}")
    return [r["x"] for r in rows.select("n", f("v").alias("x")).orderBy("n").collect()]


def test_vocabularies():
    assert len(vocab.STATES) == 50 and len(vocab.GRADES) == 27 and len(set(vocab.GRADES)) == 27 and len(vocab.SCHOOL) == 12


def test_grades(spark):
    high = [f"High School {y}" for y in ("Freshman", "Sophomore", "Junior", "Senior")]
    inputs = ["K-8", "7-12", "10", "10th Grade", "Grade 1", "Ph.D.", "Vocational or Trade Student", "grades 9,11", "Grades 2, 5, 11", "13", "12-9", "", None, "12th Grade", "grades 12 9"]
    expected = [
        ["Kindergarten", *(f"Grade {n}" for n in range(1, 9))],
        ["Grade 7", "Grade 8", *high],
        high[1:2],
        high[1:2],
        ["Grade 1"],
        ["Doctoral Student"],
        ["Vocational or Trade Student"],
        high[:3],
        ["Grade 2", "Grade 5", high[2]],
        [],
        [],
        [],
        [],
        high[3:],
        [high[3], high[0]],
    ]
    assert values(spark, S.grades, inputs) == expected


def test_states(spark):
    inputs = ["Colorado", "co", "West Virginia", "washington dc", "Washington, D.C.", "District of Columbia", "New York and Texas", "", None, "Kansas"]
    assert values(spark, S.states, inputs) == [["CO"], ["CO"], ["WV", "VA"], [], ["WA"], [], ["NY", "TX"], [], [], ["KS"]]


def test_tags_hop_once(spark):
    inputs = ["veteran", "cancer-survivor", "future-teachers", "Future Teacher", "engineering", " Low Income ", "", None]
    assert values(spark, S.tag, inputs) == ["veteran", "cancer-affected", "education", "future-teachers", "engineering", "financial-need", None, None]


def test_keys(spark):
    assert values(spark, S.slug, ["  AT&T  Fund! ", None, "--"]) == ["at-and-t-fund", "", ""]
    assert values(spark, S.provider_key, ["AT&T"]) == ["atandt"] and values(spark, S.canonical, ["AT&T"]) == ["at and t"]
    titles = ["2024 Smith Memorial Scholarship Fall", "Smith Memorial Award 2025 (No. 3)", "Scholarship 2024", "The 5th Annual Prize"]
    assert values(spark, S.title_key, titles) == ["smith memorial", "smith memorial", "scholarship 2024", "the annual prize"]


def test_words_and_duplicate_keys(spark):
    assert values(spark, lambda c: S.words(c), ["Café Société 2024 & Fall", None]) == [["cafe", "societe", "and"], []]
    pairs = spark.createDataFrame([("Acme Fund", "Acme Écoles Scholarship 2025"), ("ACME fund", "Ecoles Award"), ("Acme", "Acme Scholarship"), ("", "Title")], "p string, t string")
    split = pairs.select(S.words("p").alias("p"), S.words("t").alias("t"))
    keys = [r[0] for r in split.select(S.duplicate_key(F.col("p"), F.col("t"))).collect()]
    assert keys == ["acme fund|ecoles", "acme fund|ecoles", None, None]


def test_addresses(spark):
    assert values(spark, S.url_key, ["HTTPS://Example.org/A/b//?q=1#x", "not a url", None, "http://example.org"]) == ["example.org/a/b", "", "", "example.org"]
    assert values(spark, S.private_host, ["http://localhost/", "http://a.localhost", "http://127.0.0.1/admin", "http://172.16.0.1", "http://172.15.0.1", "https://10.example.org"]) == [True, True, True, True, False, True]
    rows = spark.createDataFrame([("https://a.org/x", "https://b.org"), ("https://A.org", "https://a.org"), ("bad", "https://a.org")], "a string, s string")
    assert [r[0] for r in rows.select(S.direct_application("a", "s")).collect()] == [True, False, False]


def test_display(spark):
    rows = spark.createDataFrame([(1234.5, False), (1000.0, True), (None, False), (2500000.0, None)], "a double, v boolean")
    assert [r[0] for r in rows.select(S.money("a", "v")).collect()] == ["Up to $1,234.5", "Varies", "Amount not published", "Up to $2,500,000"]
    assert values(spark, S.date_label, ["2026-03-05T10:00", "2026-02-30", None, ""]) == ["Mar 5, 2026", "Date unavailable", "No deadline published", "No deadline published"]
    assert values(spark, S.yes_no, [True, False, None], "boolean") == ["Yes", "No", "Not published"]
    assert values(spark, S.confidence, ["0.5", "1.1", "", None, "x", "1"]) == [0.5, None, 0.0, 0.0, None, 1.0]


def test_overlap(spark):
    rows = spark.createDataFrame([(["a", "b", "b"], ["b", "c", "d", "a"]), ([], ["a"]), (["x"], ["y"])], "a array<string>, b array<string>")
    assert [r[0] for r in rows.select(S.overlap_ratio(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]


@pytest.mark.parametrize(
    ("word", "stem"),
    [("caresses", "caress"), ("flies", "fli"), ("dies", "die"), ("mules", "mule"), ("agreed", "agre"), ("owned", "own"), ("humbled", "humbl"), ("sizing", "size"), ("meeting", "meet"), ("stating", "state"), ("itemization", "item"), ("sensational", "sensat"), ("traditional", "tradit"), ("reference", "refer"), ("colonizer", "colon"), ("plotted", "plot"), ("scholarships", "scholarship"), ("engineering", "engin"), ("generously", "generous"), ("happy", "happi"), ("skies", "sky"), ("news", "news"), ("by", "by")],
)
def test_stems(word, stem):
    assert fts.stem(word) == stem


def test_web_search(spark):
    docs = ["The engineering scholarships of Texas", "Texas grants for engineers", "A scholarship for nurses in Ohio", "Engineer in Texas, no scholarship"]
    rows = spark.createDataFrame(list(enumerate(docs)), "n int, t string").select("n", fts.analyse("t").alias("d"))

    def found(query):
        return [r["n"] for r in rows.where(fts.matches(F.col("d"), query)).orderBy("n").collect()]

    assert found("engineer texas") == [0, 1, 3] and found('"engineering scholarship"') == [0] and found("scholarship -texas") == [2]
    assert found("nurse or grants") == [1, 2] and found("the") == [] and found('"scholarships of texas"') == [0]


def test_states_in_one_pass(spark):
    """Names within names, at one place twice, and in any order; one search of the text instead of one a state."""
    from pyspark.sql import functions as F

    from tessera.functions import vocab
    from tessera.functions import scalars as S

    texts = ["West Virginia, arkansas", "Kansas and kansas; NEW-YORK", "Arkansas Delaware", "", None, " tx", "virginian", "Washington D.C.", "New Mexico_Maine New Jersey west virginia Virginia"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select(S.states("t").alias("s"))
    assert [r["s"] for r in frame.collect()] == [["WV", "AR", "VA"], ["NY", "KS"], ["AR", "DE"], [], [], ["TX"], [], [], ["WV", "NJ", "NM", "VA", "ME"]]
    assert not any(a.startswith(f"{b} ") for a in vocab.STATES for b in vocab.STATES)
    assert frame._jdf.queryExecution().optimizedPlan().toString().upper().count("RLIKE") <= 2
