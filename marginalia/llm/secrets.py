"""Secret scans: fixed patterns, and a battery of randomness tests for keys that no pattern names.

Candidates are whole runs of key characters, and the parts of a run between =, /, _ and - (a key that a name or a path is
joined to). For each one the encoding is inferred (the smallest alphabet that holds its characters) and three tests ask
whether it looks drawn uniformly from that alphabet: chi-squared over the symbols, runs above and below the alphabet's
middle, serial correlation of neighbours. Fisher's method combines them into one p-value of a token.

False-discovery control is by families, and works from both sides on all tokens of the corpus that were looked at. First,
one family for each encoding and length class: Benjamini-Hochberg over the battery's p-values, at level `alpha`, says which
tokens are not random. Then, of the rest, a token counts only with evidence against ordinary writing: the likelihood ratio
of the uniform source to a fixed model of writing is an e-value, so 1 / ratio bounds the p-value of "this is ordinary
writing", and shrinks only as fast as length allows. Benjamini-Hochberg over these, one family for each length class, keeps
the expected share of false finds under q; tokens that the battery rejected are in that family with p = 1: where many
short tokens were looked at, a short one must show more. p-values are counted in quarter steps of their logarithm.

Defined cases: a null text is empty and has no spans. A null doc_id passes through. Repeated rows come out once each
and count as candidates once each. Ties at a threshold are found together. Only doc_id and text are read. Very long texts
are read whole, in time linear in their length and spans (but for sorting the spans); an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, kept

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_HINT = re.compile("pass|secret|token|api")
ACCESS = re.compile("AKIA[A-Z0-9]{12,}")
HEX = re.compile("[0-9a-f]{32,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
PART = re.compile("[A-Za-z0-9+]+")

#: Encodings by growing size of alphabet; decimal numbers are no keys.
LOWER, UPPER, DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = {
    "decimal": DIGIT,
    "hex": DIGIT + "abcdef",
    "hex_upper": DIGIT + "ABCDEF",
    "lower": LOWER,
    "upper": UPPER,
    "base32": UPPER + "234567",
    "base36": DIGIT + LOWER,
    "base36_upper": DIGIT + UPPER,
    "letters": UPPER + LOWER,
    "base62": UPPER + LOWER + DIGIT,
    "base64": UPPER + LOWER + DIGIT + "+/",
    "base64url": UPPER + LOWER + DIGIT + "-_",
    "any": UPPER + LOWER + DIGIT + "+/-_=",
}

# Per cent of each letter a to z in English text.
LETTER_SHARE = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)
# How ordinary writing moves between lower case, capitals, digits and marks; the first row starts a token.
MOVES = {
    "": (0.5, 0.3, 0.15, 0.05),
    "l": (0.94, 0.02, 0.02, 0.02),
    "u": (0.36, 0.6, 0.02, 0.02),
    "d": (0.07, 0.06, 0.8, 0.07),
    "s": (0.4, 0.15, 0.15, 0.3),
}
STEP, TOP = 0.25, 400  # log10 p in quarter steps, the last one open


def encoding(token: str) -> str:
    chars = set(token)
    return next(name for name, alphabet in ENCODINGS.items() if chars <= set(alphabet))


def _above(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(token: str, alphabet: str) -> tuple[float, float, float]:
    """p-values of uniformity, runs and serial correlation, each small for what isn't random."""
    n, k = len(token), len(alphabet)
    x = [alphabet.index(c) for c in token]
    counts = [0] * k
    for v in x:
        counts[v] += 1
    chi = k / n * sum(c * c for c in counts) - n
    uniform = _above((chi - (k - 1)) / math.sqrt(2 * (k - 1) * (1 - 1 / n)))
    high = [v >= k / 2 for v in x]
    a = sum(high)
    b = n - a
    runs = 1 + sum(p != q for p, q in zip(high, high[1:]))
    mean = 2 * a * b / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    run_p = 2 * _above(abs(runs - mean) / math.sqrt(var)) if var > 0 else 2.0**-n * n
    centre = sum(x) / n
    spread = sum((v - centre) ** 2 for v in x)
    r = sum((p - centre) * (q - centre) for p, q in zip(x, x[1:])) / spread if spread else 1.0
    serial = 2 * _above(abs(r + 1 / n) * math.sqrt(n))
    return uniform, min(1.0, run_p), serial


def fisher(ps: tuple[float, float, float]) -> float:
    """Combined p of three independent tests: the tail of chi-squared with 6 degrees."""
    h = -sum(math.log(max(p, 1e-300)) for p in ps)
    return math.exp(-h) * (1 + h + h * h / 2)


def _log_writing() -> dict[tuple[str, str], tuple[float, str]]:
    """log10 probability and class of a character, by the class before it."""
    total, out = sum(LETTER_SHARE), {}
    for before, row in MOVES.items():
        for kind, chars, p in zip("luds", (LOWER, UPPER, DIGIT, "+/-_="), row):
            for i, c in enumerate(chars):
                share = LETTER_SHARE[i] / total if kind in "lu" else 1 / len(chars)
                out[before, c] = math.log10(p * share), kind
    return out


WRITING = _log_writing()


def surprise(token: str, alphabet: str) -> float:
    """log10 of the likelihood ratio of the uniform source to ordinary writing; -surprise bounds log10 p of writing."""
    out, before = -len(token) * math.log10(len(alphabet)), ""
    for c in token:
        p, before = WRITING[before, c]
        out -= p
    return out


def length_class(n: int) -> int:
    """Classes of a quarter of an octave; the last is open."""
    return min(48, int(4 * math.log2(n)))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by start, then kind."""
    out = []
    if ASSIGN_HINT.search(text.lower()):
        out += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(1, *m.span()) for m in ACCESS.finditer(text)]
    out += [(2, *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], s[0]))


def parts(text: str):
    """(start, end) of whole runs, each followed by its parts of 20 characters or more, if it falls into parts."""
    for m in CANDIDATE.finditer(text):
        yield m.span()
        start, end = m.start(), m.start() + len(m[0].rstrip("="))
        for x in PART.finditer(m[0]):
            if x.end() - x.start() >= 20 and (x.start(), start + x.end()) != (0, end):
                yield start + x.start(), start + x.end()


def joined(spans: list[tuple[int, int, int]]) -> list[list[int]]:
    """[start, end] of what the spans, sorted by start, cover together."""
    out: list[list[int]] = []
    for _, s, e in spans:
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def candidates(text: str, base: list[tuple[int, int, int]], tried: Counter | None = None) -> list[tuple[int, int, int, int, int, int]]:
    """(start, end, family of the battery, step of its p-value, step of the bound on p of writing, run) of tokens outside base spans, but for decimal ones.

    run: where the list has the whole run that a part is of, else -1. Only tokens with some evidence are returned; tried
    counts all that were looked at, by family and step of the battery.
    """
    out, covered, at, run = [], joined(base), 0, -1
    for s, e in parts(text):  # by start, so base spans are passed once
        while at < len(covered) and covered[at][1] <= s:
            at += 1
        token = text[s:e].rstrip("=")
        if len(token) < 20 or at < len(covered) and covered[at][0] < e:
            continue
        name = encoding(token)
        of = family(name, len(token))
        p = 0.0 if name == "decimal" else fisher(battery(token, ENCODINGS[name]))
        step = min(TOP, int(-math.log10(max(p, 1e-300)) / STEP))
        if tried is not None:
            tried[of, step] += 1
        if name != "decimal" and (high := surprise(token, ENCODINGS[name])) > 0:
            inside = run >= 0 and e <= out[run][1]
            out.append((s, e, of, step, min(TOP, int(high / STEP)), run if inside else -1))
            run = run if inside else len(out) - 1
    return out


def family(name: str, n: int) -> int:
    """One number for an encoding and a length class."""
    return 64 * list(ENCODINGS).index(name) + length_class(n)


def found(text: str, bars: Bars) -> list[tuple[int, int, int]]:
    """All spans of a text, added ones where a candidate passes the bars."""
    base = base_spans(text)
    some = candidates(text, base)
    passed = [bars.passes(*x[2:5]) for x in some]
    more = [(3, x[0], x[1]) for x, own in zip(some, passed) if own and not (x[5] >= 0 and passed[x[5]])]  # a part of a found run is found with it
    return sorted(base + more, key=lambda s: (s[1], s[0]))


def said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


RAW = "n_assign long, n_access long, n_hex long, base_sha256 string, base array<struct<k:int,s:long,e:long>>, more array<struct<s:long,e:long,of:int,step:int,evidence:int,run:int>>, tried array<struct<of:int,step:int,n:long>>"


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id and what one pass over each text shows: base spans, candidates, and how many tokens were looked at by family and step."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        def structs(longs, ints):
            return pa.list_(pa.struct([(n, pa.int64()) for n in longs] + [(n, pa.int32()) for n in ints]))

        types = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.struct([("k", pa.int32()), ("s", pa.int64()), ("e", pa.int64())])), structs("se", ("of", "step", "evidence", "run")), pa.list_(pa.struct([("of", pa.int32()), ("step", pa.int32()), ("n", pa.int64())]))]
        names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "more", "tried"]
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                n = [sum(k == i for k, _, _ in base) for i in range(3)]
                more = candidates(text, base, tried := Counter())
                rows.append((*n, hashlib.sha256(said(base).encode()).hexdigest(), [dict(zip("kse", x)) for x in base], [dict(zip(("s", "e", "of", "step", "evidence", "run"), x)) for x in more], [{"of": of, "step": step, "n": m} for (of, step), m in tried.items()]))
            columns = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(columns, types))], names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {RAW}")


@dataclass(frozen=True)
class Bars:
    """What a candidate must pass: by family the least step at which the battery rejects it, by length class the least evidence."""

    rejected: dict[int, int]
    evidence: dict[int, int]

    def passes(self, of: int, step: int, evidence: int) -> bool:
        return step < self.rejected.get(of, TOP + 1) and evidence >= self.evidence.get(of % 64, TOP + 1)

    def column(self, of: Column, step: Column, evidence: Column) -> Column:
        def at(table: dict[int, int], key: Column) -> Column:
            return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key), F.lit(TOP + 1)) if table else F.lit(TOP + 1)

        return (step < at(self.rejected, of)) & (evidence >= at(self.evidence, of % 64))


def accepted(steps: Counter, tried: int, q: float) -> int:
    """Benjamini-Hochberg over p-values counted by step: the least step that is accepted, TOP + 1 if none is.

    A p-value of step k is at most 10 ** -(k * STEP), and counts as that.
    """
    least, rank = TOP + 1, 0
    for step in sorted(steps, reverse=True):
        rank += steps[step]
        if 10 ** (-step * STEP) <= q * rank / tried:
            least = step
    return least


def bars(scans: DataFrame, q: float = 0.01, alpha: float = 1e-3) -> Bars:
    """The bars of both controls: families x steps counts reach the driver, whatever the corpus."""
    battery_counts, tried, evidence = defaultdict(Counter), Counter(), defaultdict(Counter)
    for r in scans.select(F.explode("tried").alias("x")).groupBy("x.of", "x.step").agg(F.sum("x.n").alias("n")).collect():
        battery_counts[r["of"]][r["step"]] += r["n"]
        tried[r["of"] % 64] += r["n"]
    rejected = {of: accepted(steps, steps.total(), alpha) for of, steps in battery_counts.items()}
    for r in scans.select(F.explode("more").alias("x")).groupBy("x.of", "x.step", "x.evidence").count().collect():
        if r["step"] < rejected[r["of"]]:
            evidence[r["of"] % 64][r["evidence"]] += r["count"]
    return Bars(rejected, {c: accepted(steps, tried[c], q) for c, steps in evidence.items()})


def secrets(docs: DataFrame, q: float = 0.01, alpha: float = 1e-3) -> DataFrame:
    """For each document its counts, the digest of its base spans, and all spans as kind:start:end."""
    scans = kept(scanned(docs), "secrets")
    limits = bars(scans, q, alpha)

    def passes(x: Column) -> Column:
        return F.coalesce(limits.column(x["of"], x["step"], x["evidence"]), F.lit(False))

    passed = F.filter("more", lambda x: passes(x) & ~passes(F.get("more", x["run"])))  # a part of a found run is found with it
    every = F.sort_array(
        F.concat(
            F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))),
            F.transform(passed, lambda x: F.struct(x["s"].alias("s"), F.lit(3).alias("k"), x["e"].alias("e"))),
        )
    )
    names = F.array(*map(F.lit, KINDS))
    spans = F.array_join(F.transform(every, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
    return scans.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"), F.size(passed).cast("long").alias("n_random"))


def redacted(docs: DataFrame, mark: str = "[SECRET]", q: float = 0.01, alpha: float = 1e-3) -> DataFrame:
    """docs, each found span of text (overlapping ones joined) replaced by mark; a null text stays null."""
    scans = kept(scanned(docs).select("more", "tried"), "secret-candidates")
    limits = bars(scans, q, alpha)
    forget(scans)
    at = docs.columns.index("text")

    def clean(text: str) -> str:
        out, end = [], 0
        for _, s, e in found(text, limits):
            if s >= end:
                out += [text[end:s], mark]
            end = max(end, e)
        return "".join(out) + text[end:]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            new = [None if x is None else clean(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
