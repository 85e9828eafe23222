import random

from marginalia.llm import decontaminate as D

R = random.Random(9)
PLAIN = lambda n: " ".join(R.choice("ab ce di fo gu ha".split()) + R.choice("ran set tin pol dus".split()) + R.choice("qo wi xu".split()) for _ in range(n))


def held(spark, docs, items):
    docs = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = D.contaminated(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    return {(r.doc_id, r.item_id): r.verbatim for r in got}


def test_one_altered_number_leaves_the_other_windows(spark):
    a, b, c = PLAIN(45), PLAIN(10), PLAIN(45)
    docs = [f"{a} 12 {b} 13 {c}", f"{PLAIN(20)} {PLAIN(30)}"]
    assert held(spark, docs, [f"{a} 12 {b} 12 {c}"]) == {(0, 0): True}


def test_values_may_become_equal_or_differ(spark):
    a, b, c = PLAIN(4), PLAIN(5), PLAIN(4)
    item = f"{a} 3 {b} 5 {c}"
    assert held(spark, [f"{a} 4 {b} 4 {c}"], [item]) == {(0, 0): False}
    long = [PLAIN(5) for _ in range(5)]
    text = lambda *values: " ".join(f"{x} {v}" for x, v in zip(long, values)) + " ende"
    assert held(spark, [text(7, 7, 7, 7, 8)], [text(3, 3, 3, 3, 3)]) == {(0, 0): False}


def test_items_of_few_plain_words_are_found(spark):
    numbers = " ".join(str(x) for x in range(12, 21))
    listed = "the " + " , ".join(f"{x} kg" for x in (12, 15, 18, 21, 24)) + " weigh less than that old table"
    items = ["Calculate 17 * 23", "Add 12 kg, 15 kg and 18 kg", numbers, listed, "alone", "12 kg 13 kg 14 kg 15 kg 16 kg"]
    docs = [f"{PLAIN(9)}: {x} {PLAIN(9)}" for x in items[:4]] + [PLAIN(40), "calculate 18 * 23", numbers.replace("16", "61")]
    swapped = listed.replace("12", "3").replace("15", "9").replace("18", "7").replace("21", "8").replace("24", "6")
    assert held(spark, [*docs, f"{PLAIN(9)}: {swapped} {PLAIN(9)}"], items) == {(0, 0): True, (1, 1): True, (2, 2): True, (3, 3): True, (7, 3): False}
    left = D.without_window(spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert [r.text for r in left.collect()] == ["alone"]
