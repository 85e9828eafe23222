import random
import re

from marginalia.llm import token_counts as T

PATH = T.default_path()


def brute(word, scores, unknown):
    """Best segmentation of one word, nothing shared and every piece length tried."""
    text = T.MARK + word
    best = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        found = [(best[s][0] + scores[text[s:end]], -best[s][1] - 1) for s in range(end) if text[s:end] in scores]
        n = len(text[end - 1].encode())
        if text[end - 1] not in scores:
            found.append((best[end - 1][0] + n * unknown, -best[end - 1][1] - n))
        s, t = max(found)
        best.append((s, -t))
    return best[-1][1]


def texts():
    r = random.Random(8)
    parts = "th er ing un pre token ize é ñ ß 日 本 😀 12 3 !! — the of a x".split()
    rows = [(i, " ".join("".join(r.choices(parts, k=r.randrange(1, 6))) for _ in range(40))) for i in range(60)]
    return rows + [(None, None), (100, ""), (101, " \n"), (102, "word\x0bword\ttoken"), (102, "word\x0bword\ttoken"), (103, "a" * 5000), (104, "the " * 20000), (105, "▁ ▁▁ <s> <0x41>")]


def test_equals_brute_force(spark):
    counter = T.Counter(PATH)
    for limit in (10**6, 10):
        got = T.token_counts(spark.createDataFrame([(*x, 0) for x in texts()], "doc_id long, text string, n_tokens int"), PATH, limit).collect()
        want, memo = [], {}
        for d, t in texts():
            words = [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]
            for w in words:
                memo.setdefault(w, None)
                if memo[w] is None:
                    memo[w] = brute(w, counter.scores, counter.unknown)
            want.append((d, len(words), sum(memo[w] for w in words)))
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_shared_prefixes_are_scored_once():
    class Watched(dict):
        asked = 0

        def get(self, *a):
            Watched.asked += 1
            return super().get(*a)

    def asked(words):
        counter = T.Counter(PATH)
        counter.scores = Watched(counter.scores)
        Watched.asked = 0
        counter.learn(words)
        return Watched.asked

    stem = "incomprehensibilities" * 5
    assert asked([stem + c for c in "abcdefghij"]) < 1.5 * asked([stem])


def test_empty_table(spark):
    assert T.token_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
