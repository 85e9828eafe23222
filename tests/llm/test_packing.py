import collections
import random
import zlib

import numpy as np
import pytest

from marginalia.llm import packing as P
from marginalia.llm.tokens import WordTokenizer, default_path

PATH = default_path()
R = random.Random(9)
ODD = ["It's I'LL we'Ve 'sx ''s don't!?'d", "a\x1cb \x85 x y　", "É éx İstanbul ΣΑΣ ſ K ½ ²3 ١٢", "<|endoftext|> a<|startoftext|>b", "​zero​width", "\U0001f600x' s", "a_b 'S", "日本語テキスト 12３４", "\x00 nul\x00x", " ", "", "ﬁ 'ſ", "x" * 3000]


def docs():
    rows = [(i, " ".join(R.choice("the of and packing windows Deficit, round-robin! über 12".split()) for _ in range(R.randrange(1, 400))), R.choice(["hot"] * 6 + ["a", "b", None, ""])) for i in range(150)]
    rows += [(1000 + i, t, "odd") for i, t in enumerate(ODD)] + [(None, None, None), (7, "again", "a"), (7, "again", "a"), (2000, "long " * 20000, "b"), (3000, "tiny", "rare")]
    return rows


def test_tokenizer_equals_the_library():
    words = WordTokenizer(PATH, limit=5)
    for t in ODD + [x[1] or "" for x in docs()]:
        assert np.frombuffer(words.encode([t])[0], "<u2").tolist() == words.tokenizer.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize(("size", "queues"), [(4096, 1000), (64, 1000), (64, 2), (100, 1)])
def test_pieces_are_a_partition_of_every_document(spark, size, queues):
    rows = docs()
    got = P.pack(spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, source string, start int").repartition(5), size=size, max_queues=queues).collect()
    words, want = WordTokenizer(PATH), collections.Counter()
    ids = {(d, s): np.frombuffer(words.encode([t or ""])[0], "<u2").astype("<u4").tolist() + [2] for d, t, s in rows}
    for d, _, s in rows:
        want[d, s] += len(ids[d, s])
    have, sequences = collections.Counter(), collections.defaultdict(list)
    for r in got:
        own = ids[r.doc_id, r.source]
        assert r.doc_tokens == len(own) and r.length > 0
        assert r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
        have[r.doc_id, r.source] += r.length
        sequences[r.sequence_id].append((r.offset, r.length, r.source))
    assert have == want
    assert sorted(sequences) == list(range(len(sequences)))
    for k, own in sequences.items():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n, _), (b, _, _) in zip(own, own[1:]))
        assert sum(n for _, n, _ in own) == size or k == len(sequences) - 1


def test_proportions_hold_in_every_window(spark):
    rows = [(i, "word " * 50, s) for i, s in enumerate(["a"] * 600 + ["b"] * 300 + ["c"] * 100)]
    got = P.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), size=1000).collect()
    by = collections.defaultdict(collections.Counter)
    for r in got:
        by[r.sequence_id][r.source] += r.length
    for k in range(45):
        assert all(abs(by[k][s] - share) <= 2 for s, share in (("a", 600), ("b", 300), ("c", 100))), by[k]


@pytest.mark.parametrize("settings", [{"targets": {"a": 0.2, "b": 0.5, "c": 0.3}}, {"alpha": 0.5}])
def test_windows_are_filled_to_the_targets_while_all_queues_last(spark, settings):
    """Every window holds the wanted tokens of each source, end to end, until the first source is empty; nothing is dropped."""
    count = {"a": 600, "b": 300, "c": 100}
    rows = [(i, "word " * 50, s) for i, s in enumerate(x for s, n in count.items() for x in [s] * n)]
    got = P.pack(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7), size=1000, **settings).collect()
    by = collections.defaultdict(collections.Counter)
    for r in got:
        by[r.sequence_id][r.source] += r.length
    tokens = {s: 51 * n for s, n in count.items()}
    wanted = settings.get("targets") or {s: n**0.5 for s, n in tokens.items()}
    share = {s: 1000 * w / sum(wanted.values()) for s, w in wanted.items()}
    lasting = int(min(tokens[s] / share[s] for s in share)) - 1
    assert lasting > 10
    for k in range(lasting):
        assert all(abs(by[k][s] - share[s]) <= 2 for s in share), (k, by[k])
    assert {s: sum(w[s] for w in by.values()) for s in tokens} == tokens


def test_schedule_serves_every_queue_and_keeps_targets():
    r = random.Random(0)
    for _ in range(200):
        tokens = [r.choice([0, 1, 5, 100, 10**5]) * r.randrange(1, 9) for _ in range(r.randrange(1, 9))]
        targets = r.choice([None, [r.random() for _ in tokens]])
        size = r.choice([64, 100, 4096])
        served, at = [0] * len(tokens), 0
        for p in P.schedule(tokens, size, targets):
            assert p.first == at and list(p.served) == served
            bounds = [p.count * p.size * a // p.units for a in p.share]
            served = [s + b - a for s, a, b in zip(served, bounds, bounds[1:])]
            at += p.count
        assert served == tokens and at == -(-sum(tokens) // size)
    first = P.schedule([10**6, 10**6, 10**6], 4096, [0.5, 0.3, 0.2])[0]
    assert [round((b - a) / P.UNITS, 3) for a, b in zip(first.share, first.share[1:])] == [0.5, 0.3, 0.2]


def test_empty_table(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_a_thousand_sources():
    """Sizes from 10 ** 3 to 10 ** 9: three phases for a source at most, no share below a token a window, all tokens served
    once, and after every full window a queue within one token of its due while all queues last."""
    import time

    r = random.Random(1)
    tokens = [int(10 ** r.uniform(3, 9)) for _ in range(1000)]
    began = time.time()
    phases = P.schedule(tokens, 4096, [n**0.7 for n in tokens])
    assert time.time() - began < 10 and len(phases) <= 3 * len(tokens)
    assert sum(p.count * p.size for p in phases) == sum(tokens)
    p = phases[0]
    units = [b - a for a, b in zip(p.share, p.share[1:])]
    assert min(units) >= P.UNITS // 4096 and sum(units) == P.UNITS
    for w in (0, 1, p.count // 2, p.count - 1):
        marks = [[v * p.size * a // p.units for a in p.share] for v in (w, w + 1)]
        gives = [d - c - (b - a) for a, b, c, d in zip(marks[0], marks[0][1:], marks[1], marks[1][1:])]
        assert sum(gives) == 4096 and all(abs(g - 4096 * u / p.units) < 2 for g, u in zip(gives, units))
        assert all(abs(b - a - w * p.size * u / p.units) < 1 for a, b, u in zip(marks[0], marks[0][1:], units))
    big = [u / n**0.7 for u, n in zip(units, tokens) if u > 50 * P.UNITS // 4096]
    assert not big or max(big) / min(big) < 1.05
    assert all(sum(b - a for p in phases for a, b in [(p.served[q], p.served[q] + p.count * p.size * p.share[q + 1] // p.units - p.count * p.size * p.share[q] // p.units)]) == n for q, n in list(enumerate(tokens))[::97])


def test_pieces_begin_in_the_phase_that_holds_them():
    tokens = [50_000, 9_000, 700, 12_345]
    phases = P.schedule(tokens, 512, [1.0, 1.0, 1.0, 2.0])
    for q, n in enumerate(tokens):
        whole = [x.tolist() for x in P.pieces(phases, q, 0, n)]
        for begin in (0, 1, n // 3, n - 1):
            start, length, window, offset = (x.tolist() for x in P.pieces(phases, q, begin, n - begin))
            assert sum(length) == n - begin and start[0] == 0
            assert (window[1:], offset[1:]) == (whole[2][-len(window) + 1 :] if len(window) > 1 else [], whole[3][-len(window) + 1 :] if len(window) > 1 else [])


def test_a_later_task_of_a_worker_tokenizes_no_run_again(monkeypatch):
    from marginalia.llm import tokens

    first = tokens.shared(PATH)
    want = first.encode(["plain words, and naïve ones"])
    monkeypatch.setattr(first.runs, "find", None)  # would raise
    assert tokens.shared(PATH) is first and tokens.shared(PATH).encode(["and plain words, and naïve ones"])[0].endswith(want[0][-4:])


def test_a_worker_that_goes_on_to_other_stages_gives_its_tokenizer_back(monkeypatch):
    import time
    import weakref

    from marginalia.llm import tokens

    monkeypatch.setattr(tokens, "_SHARED", {})
    first = tokens.shared(PATH, 0.3)
    for _ in range(3):  # in use it stays
        time.sleep(0.15)
        first.encode(["plain words"])
    assert tokens.shared(PATH, 0.3) is first
    gone, want = weakref.ref(first), first.encode(["plain words, and naïve ones"])
    del first
    for _ in range(100):
        if gone() is None:
            break
        time.sleep(0.1)
    assert gone() is None and not tokens._SHARED
    assert tokens.shared(PATH, 0.3).encode(["plain words, and naïve ones"]) == want
