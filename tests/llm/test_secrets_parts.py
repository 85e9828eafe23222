import random
import time

from marginalia.llm import secrets as S

JOINED = {"license_key=": ("hex_upper", 32), "/services/hooks/incoming/": ("base62", 24), "private_key=": ("base36", 32)}


def test_keys_joined_to_words_are_candidates():
    r = random.Random(6)
    for before, (name, n) in JOINED.items():
        found = 0
        for _ in range(200):
            key = "".join(r.choices(S.ENCODINGS[name], k=n))
            text = f"see {before}{key} there"
            at = text.index(key)
            found += (at, at + n) in [x[:2] for x in S.candidates(text, S.base_spans(text))]
        assert found >= 180, (before, found)


def test_parts_of_a_run():
    text = "x " + "a" * 20 + "_" + "b" * 19 + "/" + "c" * 21 + "== " + "d" * 20 + "="
    assert list(S.parts(text)) == [(2, 66), (2, 22), (43, 64), (67, 88)]


def test_joined_keys_are_redacted(spark):
    r = random.Random(7)
    keys = ["".join(r.choices(S.ENCODINGS["base62"], k=40)) for _ in range(30)]
    df = spark.createDataFrame([(i, f"see /services/hooks/incoming/{k} there") for i, k in enumerate(keys)], "doc_id long, text string")
    text = {x.doc_id: x.text for x in S.redacted(df).collect()}
    assert all(k not in text[i] for i, k in enumerate(keys))


def test_tokens_that_the_battery_rejects_count_as_tests(spark):
    kind = "more array<struct<s:long,e:long,of:int,step:int,evidence:int>>, tried array<struct<of:int,step:int,n:long>>"
    bars = lambda *rows: S.bars(spark.createDataFrame(list(rows), kind))
    weak, strong = [(0, 20, 17, 0, 8)] * 10, [(0, 20, 17, 0, 60)]
    assert bars((weak, [(17, 0, 10)])) == S.Bars({17: S.TOP + 1}, {17: 8})
    assert bars((weak, [(17, 0, 10)]), ([], [(17, 90, 10**6)])) == S.Bars({17: 90}, {17: S.TOP + 1})
    assert bars((weak + strong, [(17, 0, 10), (17, 90, 10**6)])) == S.Bars({17: 90}, {17: 60})
    rejected = [(0, 20, 17, 90, 400)] * 5
    assert bars((rejected + strong, [(17, 0, 1), (17, 90, 10**6)])) == S.Bars({17: 90}, {17: 60})
    assert bars((rejected, [(17, 90, 10**6)])).passes(17, 90, 400) is False


def test_both_controls_equal_their_plain_form():
    r = random.Random(3)
    for _ in range(200):
        ps = [10 ** (-r.choice((0, 0, 0, 2, 9, 30)) * S.STEP) for _ in range(r.randrange(1, 60))]
        q, m = r.choice((0.001, 0.01, 0.2)), 60
        ranked = sorted(ps)
        cut = max((p for k, p in enumerate(ranked, 1) if p <= q * k / m), default=None)
        steps = S.Counter(round(-S.math.log10(p) / S.STEP) for p in ps)
        got = S.accepted(steps, m, q)
        assert [p <= cut if cut is not None else False for p in ps] == [round(-S.math.log10(p) / S.STEP) >= got for p in ps]


def test_ordinary_words_are_looked_at(spark):
    text = "usr/local/lib/python/site-packages electroencephalographically 123456789012345678901234 password=abcdefghijklmnopqrstuvwxyz"
    (row,) = S.scanned(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert sum(x.n for x in row.tried) == 3 and not row.more and all(x.step > 8 for x in row.tried if x.of // 64 == 0)


def brute_candidates(text, base):
    """(start, end) of all tokens that candidates() must try, each compared with every base span."""
    return [(s, e) for s, e in S.parts(text) if len(text[s:e].rstrip("=")) >= 20 and not any(a < e and s < b for _, a, b in base)]


def test_one_walk_over_base_spans_equals_all_comparisons():
    r = random.Random(11)
    pieces = ["secret=", "token: ", "AKIA", "_", "/", " ", "= ", "=="]
    for _ in range(300):
        text = "".join(r.choice((r.choice(pieces), "".join(r.choices(S.ENCODINGS[r.choice(("hex", "base62", "upper"))], k=r.choice((5, 20, 33, 40)))))) for _ in range(40))
        base, tried = S.base_spans(text), S.Counter()
        got = S.candidates(text, base, tried)
        wanted = brute_candidates(text, base)
        assert tried.total() == len(wanted) and [x[:2] for x in got] == [x for x in wanted if x in {y[:2] for y in got}]
        for s, e, *_, run in got:
            around = [i for i, x in enumerate(got) if x[0] <= s and e <= x[1] and x[1] - x[0] > e - s]
            assert around == ([run] if run >= 0 else [])


def test_parts_of_found_runs_are_found_with_them(spark):
    r = random.Random(12)
    key = lambda n: "".join(r.choices(S.ENCODINGS["base62"], k=n))
    texts = [f"{key(40)}/{key(40)} and /some/ordinary/path/to/{key(40)}_x {key(40)}=" for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    limits = S.bars(S.scanned(df))
    got = {x.doc_id: x.spans for x in S.secrets(df).collect()}
    assert all(got[i] == S.said(S.found(t, limits)) for i, t in enumerate(texts))
    assert sum(x.count("random") for x in got.values()) >= 55


def test_a_long_dump_of_keys_takes_linear_time():
    r = random.Random(13)
    text = " ".join("secret=" + "".join(r.choices(S.ENCODINGS["base62"], k=40)) + " " + "".join(r.choices(S.ENCODINGS["base64"], k=40)) for _ in range(20_000))
    begin = time.process_time()
    base = S.base_spans(text)
    got = S.candidates(text, base)
    assert len(base) == 20_000 and len(got) > 19_000 and time.process_time() - begin < 20


def test_planted_keys_by_encoding_and_length():
    """Recall of keys of every encoding among ordinary tokens, with and without the second control, and what each finds among ordinary tokens."""
    for (name, n), x in planted(random.Random(14), keys=60).items():
        assert x["battery"] >= 0.95 and x["both"] >= 0.85 and x["false"] == 0, (name, n, x)
        assert x["both"] <= x["battery"] and x["false"] <= x["false of battery"], (name, n, x)


ORDINARY = """internationalisation/of/electroencephalographically measuredCounterRevolutionaries_and_others usr/local/lib/python/site-packages
getApplicationContextFromServletRequest MAXIMUM_NUMBER_OF_CONNECTIONS_PER_HOST www-example-com/articles/2019/07/the-quick-brown-fox
pneumonoultramicroscopicsilicovolcanoconiosis AbstractSingletonProxyFactoryBean supercalifragilisticexpialidocious 2021-05-17T08-15-00_backup_file""".split()


def planted(r, keys=200, dilution=1):
    """By (encoding, length): shares of planted keys and of ordinary tokens found by both controls and let pass by the battery alone.

    dilution: how many times each ordinary token counts as looked at.
    """
    out = {}
    for name in ("hex", "hex_upper", "lower", "upper", "base32", "base36", "letters", "base62", "base64", "base64url"):
        for n in (20, 24, 32, 40, 64):
            planted_texts = ["see " + "".join(r.choices(S.ENCODINGS[name], k=n)) + " there" for _ in range(keys)]
            ordinary = [f"see {x} there" for x in ORDINARY]
            steps, evidence, tried = S.defaultdict(S.Counter), S.defaultdict(S.Counter), S.Counter()
            passing = {}
            for text, times in [(x, 1) for x in planted_texts] + [(x, keys * dilution) for x in ordinary]:
                S.candidates(text, S.base_spans(text), own := S.Counter())
                passing[text] = list(own)
                for (of, step), m in own.items():
                    steps[of][step] += m * times
                    tried[of % 64] += m * times
            rejected = {of: S.accepted(c, c.total(), 1e-3) for of, c in steps.items()}
            for text, times in [(x, 1) for x in planted_texts] + [(x, keys * dilution) for x in ordinary]:
                for x in S.candidates(text, S.base_spans(text)):
                    if x[3] < rejected[x[2]]:
                        evidence[x[2] % 64][x[4]] += times
            limits = S.Bars(rejected, {c: S.accepted(e, tried[c], 0.01) for c, e in evidence.items()})

            def both(text):
                return any(k in (2, 3) for k, _, _ in S.found(text, limits))

            def battery(text):
                return bool(S.HEX.search(text)) or any(step < rejected[of] for of, step in passing[text])

            out[name, n] = {
                "both": sum(map(both, planted_texts)) / keys, "battery": sum(map(battery, planted_texts)) / keys,
                "false": sum(map(both, ordinary)) / len(ordinary), "false of battery": sum(map(battery, ordinary)) / len(ordinary),
            }
    return out
