"""Paragraphs and annotations of long texts."""

import random
import time

from marginalia.operators import papers


def test_first_places_equal_a_plain_search():
    r = random.Random(2)
    for letters, longest in (("ab", 20), ("ab c", 40), ("é😀abc", 12), ("a", 30)):
        for n in (10, 65, 300):
            lines = ["".join(r.choice(letters) for _ in range(r.randrange(longest))) for _ in range(n)]
            text, lines = "\n".join(lines), [x for x in lines if x.strip(" ")]
            assert papers.first_places(text, lines) == [text.find(x) for x in lines]


def test_a_hundred_thousand_lines_and_notes(spark):
    """Each note meets the lines of its stretch alone; by pairs these would be ten thousand million rows."""
    n = 100_000
    body = [f"line {i:06d} of a long text" for i in range(n)]  # all of one length
    text, step = "\n".join(body), len(body[0]) + 1
    began = time.time()
    lines = papers.paragraphs(spark.createDataFrame([(1, text), (2, "other\n")], "id long, text string"))
    notes = spark.range(n).selectExpr("1L AS id", f"id * {step} + 3 AS start", f"id * {step} + 9 + (id % 2) * 20 AS end", "'x' AS kind")
    out = papers.segments(lines, notes).groupBy("id", "kind").count().collect()
    # Every second note goes on into the next line and is none.
    assert {(x.id, x.kind): x["count"] for x in out} == {(1, "x"): n // 2, (1, "normal"): n // 2 * 2 + n // 2, (2, "normal"): 1}
    assert time.time() - began < 60


def test_segments_equal_plain_pairs(spark):
    r, texts, notes = random.Random(4), [], []
    for i in range(12):
        lines = ["".join(r.choice("abc ") for _ in range(r.choice([0, 5, 40, 3000]))) for _ in range(r.choice([1, 20, 90]))]
        texts.append((i, "\n".join(lines)))
        for k in range(60):
            start = r.randrange(len(texts[-1][1]) + 1)
            notes.append((i, start, start + r.choice([0, 3, 30, 1500]), f"k{k}"))
    want = []
    for i, text in texts:
        for number, x in enumerate([x for x in text.split("\n") if x.strip(" ")]):
            at, reached = text.find(x), 0
            for _, a, b, kind in sorted((n for n in notes if n[0] == i), key=lambda n: (n[1], n[2])):
                if at <= a and b <= at + len(x):
                    if a - at > reached:
                        want.append((i, number, reached, a - at, "normal"))
                    want.append((i, number, a - at, b - at, kind))
                    reached = b - at
            if reached < len(x):
                want.append((i, number, reached, len(x), "normal"))
    got = papers.segments(papers.paragraphs(spark.createDataFrame(texts, "id long, text string")), spark.createDataFrame(notes, "id long, start long, end long, kind string"))
    assert sorted(map(tuple, got.collect())) == sorted(want)
