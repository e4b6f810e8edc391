from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from graphloom.llm.rules import measures, quality_rules

SCHEMA = "doc_id long, text string, n_words long"


def brute(text):
    t = text or ""
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", t) if w]
    lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(5)}
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), failed


def check(spark, texts):
    rows = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in quality_rules(rows).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), t


def test_edges(spark):
    check(spark, [None, "", " \n\t", "a", "a b c d e " * 3, "x\nx\n\nx ", "é# ü| z\x1cq", "the of and to in is that for it with " * 1, "w " * 20000 + "end"])


def test_empty_table(spark):
    got = quality_rules(spark.createDataFrame([], SCHEMA))
    assert got.count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \n#\t", max_size=60), min_size=1, max_size=8))
def test_against_brute_force(spark, texts):
    check(spark, texts)


def test_clean_text_is_kept(spark):
    text = "The cat sat on the mat and then it went to the other side of the old house."
    row = quality_rules(spark.createDataFrame([(None, text, 1), (None, text, 1)], SCHEMA)).collect()
    assert [r.kept for r in row] == [True, True]


def test_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "a a b", 7, "x", 0.5)], "doc_id long, text string, N_words long, _q_words string, symbol_ratio double")
    row = measures(rows).first()
    assert (row.doc_id, row.n_words, row._q_words, row.symbol_ratio) == (1, 3, "x", 0.0)
