import re
from collections import Counter

from compare import assert_same, duck

from tidemark.llm import quality
from tidemark.llm.queries import OP6_SQL, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)),
        len(covered),
        failed,
    )


CASES = [
    None,
    "",
    " \t\n\x0b\x0c\r ",
    "one two",
    "a b c a b c",
    "x " * 5000,
    "   é",
    "# * $ % & | < >",
    "same line\nsame line\n\n \nother",
    "\n".join(f"The ab{i} of cd{i} is ef{i} gh{i} by ij{i}." for i in range(40)),
    "long" * 60000,
]


def test_cases_match_brute_force(spark):
    rows = [(i, text, "clash") for i, text in enumerate(CASES)] + [(3, CASES[3], "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    got = quality.quality_rules(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(
            CASES[r.doc_id]
        ), r.doc_id
        assert not (r.base_failed and r.kept)
    assert {r.doc_id for r in got if r.kept} == {9}


def test_filter_keeps_columns_and_rows_as_they_are(spark):
    docs = spark.createDataFrame([(9, CASES[9], "x", 1), (1, "", "y", 2)], "doc_id long, text string, kept string, n_words int")
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert [tuple(r) for r in kept.collect()] == [(9, CASES[9], "x", 1)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert quality.quality_rules(docs).count() == 0
    assert quality.keep_good(docs).count() == 0


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert_same(QUERIES["op6_quality_rules"](spark, sf), duck(sf), OP6_SQL)


def test_no_python_in_the_plan(spark):
    plan = QUERIES["op6_quality_rules"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_the_filter_does_not_repeat_the_metrics(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = quality.keep_good(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(") == 2
    kept = {r.doc_id for r in quality.quality_rules(docs).collect() if r.kept}
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == kept
