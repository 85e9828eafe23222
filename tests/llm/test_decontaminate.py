import random

from marginalia.llm import decontaminate as D

R = random.Random(4)
WORDS = [f"{a}{b}" for a in "ba ce di fo gu ha je ki lo mu".split() for b in "ran set tin pol dus".split()]
STORY = lambda n: " ".join(R.choice(WORDS) for _ in range(n))
ITEMS = [
    (1, "A farmer sells 12 apples to Alice for 3 dollars each and then buys 12 pears with half of the money he got from Alice today."),
    (2, STORY(40) + "."), (3, "tiny item here now"), (4, None), (None, STORY(20)), (5, ""), (6, "12 13 14 15 16 17 18 19 20"),
]
SWAPPED = "a farmer sells 7 apples to Bruno for 9 euros each and then buys 7 pears with half of the money he got from Bruno today"
BROKEN = "a farmer sells 7 apples to Bruno for 9 euros each and then buys 8 pears with half of the money he got from Carla today"
DOCS = [
    (10, STORY(100)), (11, STORY(30) + " " + ITEMS[1][1] + " " + STORY(30)), (12, STORY(9) + ". " + SWAPPED + " " + STORY(9)), (13, STORY(9) + ". " + BROKEN + ". " + STORY(9)),
    (14, None), (15, " \n"), (None, ITEMS[1][1].upper()), (None, STORY(50)), (16, "so: TINY item, here now! " + STORY(20)), (17, ITEMS[4][1]),
    (18, "1 2 3 4 5 6 7 8 9 10 11 12"), (19, " ".join(ITEMS[1][1].split()[5:25])), (19, " ".join(ITEMS[1][1].split()[5:25])), (20, STORY(30000) + " " + ITEMS[1][1]), (21, " ".join(ITEMS[1][1].split()[:10])),
]


def frames(spark):
    return spark.createDataFrame([(*x, 0) for x in DOCS], "doc_id long, text string, h int"), spark.createDataFrame(ITEMS, "item_id long, text string")


def test_finds_verbatim_and_reparameterised(spark):
    got = {(r.doc_id, r.item_id): r.verbatim for r in D.contaminated(*frames(spark)).collect()}
    assert got == {(11, 2): True, (12, 1): False, (None, 2): True, (16, 3): True, (17, None): True, (19, 2): True, (20, 2): True}


def brute(text, items, width=8):
    """Shared windows of template words, by comparing every place with every place."""

    def words(t):
        out, first = [], True
        for w in (t or "").split():
            x = D.template(w, first)[0]
            first = w.rstrip("\"'”’»)")[-1:] in (".", "!", "?", ":")
            out += [x] if x else []
        return out

    a, hits = words(text), set()
    for i, t in items:
        b = words(t)
        size = min(width, len(b))
        for p in range(len(a) - size + 1):
            for q in range(len(b) - size + 1):
                own = a[p : p + size]
                if size > 1 and own == b[q : q + size] and 2 * sum(x not in D.PLACEHOLDERS for x in own) >= size:
                    hits.add((i, p))
    return hits


def test_scan_loses_no_window(spark):
    docs = [(i, t) for i, (_, t) in enumerate(DOCS) if t is None or len(t) < 5000]
    items = spark.createDataFrame(ITEMS, "item_id long, text string").where("text is not null")
    own = D._scan(items, "item_id", [8], whole=8).collect()
    lengths = sorted({len(r.words.split(" ")) for r in own})
    every = D._scan(spark.createDataFrame(docs, "key long, text string"), "key", lengths).collect()
    for i, t in docs:
        got = {(a.item_id, r.pos) for r in every if r.key == i for a in own if (a.h, a.words) == (r.h, r.words)}
        assert got == brute(t, [x for x in ITEMS if x[1]]), i


def test_clean_keeps_the_others(spark):
    docs, items = frames(spark)
    left = D.clean(docs, items)
    assert left.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 10, 13, 14, 15, 18, 21]


def test_empty_tables(spark):
    docs, items = frames(spark)
    assert D.contaminated(docs.limit(0), items).count() == 0
    assert D.contaminated(docs, items.limit(0)).count() == 0 and D.clean(docs, items.limit(0)).count() == len(DOCS)
