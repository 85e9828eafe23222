import collections
import re

import pytest

from marginalia.llm import quality_rules as Q

TEXTS = [
    None, "", " \t\n\x0b\x0c\r ", "one", "a b", "a b c", "a b c a b c", "x x x x x x", "x x x x", "a b c d e",
    "line one\nline one\n\n \nother\nline one\r\nline one\r", "a b c d a b c d a b", "#*$%&|<> word# é😀", "A B\x0bC\x0cD", "!? Ab CD",
    "p q r s p q r t p q r u " * 40, "w%d " * 3, " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i % 45}" for i in range(60)), "z " * 5000,
]


def brute(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    seen = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_statistics_equal_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "a b"), (3, "one")]
    got = Q.with_stats(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("base_failed", Q.base_failed()).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(r.text), r.text


def corpus(spark):
    good = [(i, " ".join(f"word{(i * 31 + j * j) % 997}" for j in range(80)), 1) for i in range(240)]
    bad = [(i, " ".join(f"word{(i * 17 + j * j) % 997}%%%" for j in range(80)), 0) for i in range(240, 400)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    return df.select("doc_id", "text"), df.select("doc_id", "quality")


def test_rules_find_the_planted_kind_and_keep_the_rest(spark):
    docs, labels = corpus(spark)
    got = {r.doc_id: r for r in Q.flagged(docs, labels).collect()}
    assert all(got[i].kept for i in range(240))
    assert not any(got[i].kept for i in range(240, 400))
    assert all(got[i].rule == 1 for i in range(240, 400))


@pytest.mark.parametrize("labels", [[], [(1, None)], [(1, 1), (1, 1)], [(1, 0)]])
def test_few_labels_leave_the_base_alone(spark, labels):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60)), "x"), (2, None, "y")], "doc_id long, text string, n_words string").drop("n_words")
    got = {r.doc_id: r.kept for r in Q.flagged(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert got == {1: True, 2: False}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert Q.flagged(docs, spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_flagged_ignores_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", 9, True)], "doc_id long, text string, n_words int, kept boolean")
    assert Q.flagged(docs, spark.createDataFrame([], "doc_id long, quality int")).first().n_words == 3
