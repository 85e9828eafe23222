"""Column functions: defaults, labels, bands, normalisers and rules, all within Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Error types, the five that the paper view counts first.
ERROR_TYPES = ("概念不清", "计算失误", "审题偏差", "方法错误", "知识盲区", "粗心")
UNKNOWN = "未知"
# Subjects.
SUBJECTS = ("数学", "物理", "化学", "英语", "生物", "语文")


def let(value: Column, body) -> Column:
    """body of value, which is evaluated once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def falsy(value: Column, zero, default) -> Column:
    """default where value is null or its type's empty value (0 or '')."""
    return F.when(value.isNull() | (value == F.lit(zero)), F.lit(default)).otherwise(value)


def or_blank(value: Column, default) -> Column:
    """default where a string is null or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), default if isinstance(default, Column) else F.lit(default))


def month_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def year_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy")


def semester_label(ts: Column, academic: bool = False) -> Column:
    """March to August is the second half of a year, else the first; academic: January and February belong to the year before."""
    spring = F.month(ts).between(3, 8)
    year = F.year(ts) - F.when(F.lit(academic) & (F.month(ts) < 3), 1).otherwise(0)
    return F.concat(year.cast("string"), F.when(spring, "-下").otherwise("-上"))


def clamp_difficulty(value: Column) -> Column:
    return F.least(F.lit(5), F.greatest(F.lit(1), falsy(value, 0, 3)))


def normalise_error_type(value: Column, answer: Column | None = None) -> Column:
    """粗心马虎 is 粗心, blank is unknown; a blank answer means a gap in knowledge."""
    out = F.when(value == "粗心马虎", "粗心").otherwise(or_blank(value, UNKNOWN))
    return out if answer is None else F.when(or_blank(F.trim(answer), "") == "", "知识盲区").otherwise(out)


def normalise_email(email: Column) -> Column:
    return F.lower(F.trim(email))


def account_error(email: Column, password: Column) -> Column:
    """The first rule that a new account breaks, else null."""
    return (
        F.when(or_blank(email, "") == "", "email_missing")
        # Fixed value: the shape of an address.
        .when(~F.trim(email).rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), "email_invalid")
        .when(or_blank(password, "") == "", "password_missing")
        .when(F.length(password) < 6, "password_short")
    )


def submission_error(subject: Column, images: Column, allowed: tuple[str, ...]) -> Column:
    return F.when(~F.coalesce(subject.isin(*allowed), F.lit(False)), "subject").when(~F.coalesce(images, F.lit(0)).between(1, 10), "images")


def input_kind(value: Column) -> Column:
    return F.when(or_blank(F.trim(value), "") == "", "reject").when(value.startswith("data:image"), "image").otherwise("text")


def has_stem(text: Column) -> Column:
    """Eight characters or more without digits, dots, enumeration commas and white space."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[0-9.、\s]", "")) >= 8


def answer_letter(value: Column) -> Column:
    up = F.upper(F.trim(value))
    return F.when(up.rlike("^[A-D]"), F.substring(up, 1, 1)).otherwise(value)


def option_letter(option: Column) -> Column:
    return F.regexp_extract(option, "^([A-Z])", 1)


def option_body(option: Column) -> Column:
    return F.regexp_replace(option, r"^[A-Z][.、\s)]*\s*", "")


def option_of(options: Column, letter: Column) -> Column:
    """The whole option of a letter, the letter itself if none begins with it."""
    return F.coalesce(F.get(F.filter(options, lambda o: o.startswith(F.concat(letter, F.lit(".")))), F.lit(0)), letter)


def inferred_answer(blocks: Column) -> Column:
    """The first block after the first that is just a letter A to D."""
    return F.get(F.filter(F.transform(F.slice(blocks, F.lit(2), F.greatest(F.size(blocks) - 1, F.lit(0))), lambda t: F.trim(t)), lambda b: b.rlike("^[A-D]$")), F.lit(0))


# Kinds of questions and the words that tell them, in the order in which they are tried.
QUESTION_KINDS = (
    ("选择题", r"[A-D]\s*[.、]"),
    ("填空题", "填空|___|（）"),
    ("判断题", "判断|正确.*错误|对.*错"),
    ("解答题", "解答|证明|计算|求解"),
    ("阅读理解", "(?i)阅读|理解|passage"),
    ("实验题", r"实验|图示|图\d"),
)


def question_type(text: Column) -> Column:
    """The first kind whose words are found."""
    told = F.array(*[F.when(text.rlike(words), kind) for kind, words in QUESTION_KINDS])
    return F.coalesce(F.get(F.array_compact(told), F.lit(0)), F.lit(UNKNOWN))


def options_of(text: Column) -> Column:
    """`L. body` for each option in a line of text: it is cut before each letter that a mark or a space follows; a body holds no such letter."""
    cut = F.filter(F.split(text, r"(?=[A-D]\s*[.、\s])"), lambda x: x.rlike(r"\A[A-D]\s*[.、\s]\s*[^A-D\n]"))
    return F.transform(cut, lambda x: F.concat(F.substring(x, 1, 1), F.lit(". "), F.trim(F.regexp_extract(x, r"\A[A-D]\s*[.、\s]\s*([^A-D\n]+)", 1))))


def question_number(text: Column) -> Column:
    """The number that a text begins with; null if there is none."""
    return F.regexp_extract(text, r"\A(\d+)", 1).try_cast("int")


def has_red_ink(payload: Column, least: int = 200) -> Column:
    """Whether a page's separated red ink is more than an empty image: longer than `least` characters."""
    return F.coalesce(F.length(payload) > least, F.lit(False))


def template(text: str, values: dict[str, Column], blanks: dict[str, str]) -> Column:
    """text with each {name} replaced by its value, or by its default where that is null or empty."""
    out = F.lit(text)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), or_blank(value, blanks.get(name, "")))
    return out


def at_paths(json: Column, *paths: str) -> Column:
    """The first of the paths that holds something that isn't empty."""
    return F.coalesce(*[F.nullif(F.get_json_object(json, p), F.lit("")) for p in paths])


def strip_fences(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"```(json)?\s*", ""), r"(?U)\A\s+|\s+\z", "")


def marked(mark: Column, found: Column) -> Column:
    """struct(is_correct, confidence, grading_mark, has_red_ink) of a question; found: whether there is a mark at all."""
    wrong = mark.rlike("[✗×xX]") | (mark == "REWRITE") | mark.rlike(r"^-\d") | mark.rlike("[○⭕]")

    def verdict(correct: bool, confidence: str) -> Column:
        return F.struct(F.lit(correct).alias("is_correct"), F.lit(confidence).alias("confidence"), mark.alias("grading_mark"), F.lit(True).alias("has_red_ink"))

    none = F.struct(F.lit(True).alias("is_correct"), F.lit("medium").alias("confidence"), F.lit("无标记").alias("grading_mark"), F.lit(False).alias("has_red_ink"))
    return F.when(~found, none).when(wrong, verdict(False, "high")).when(mark.rlike("[✓√]"), verdict(True, "high")).otherwise(verdict(False, "low"))


def ratio_band(score: Column, full: Column) -> Column:
    ratio = score / F.nullif(full, F.lit(0))
    return F.when(ratio >= 0.7, "high").when(ratio >= 0.5, "middle").otherwise("low")


def score_band(score: Column) -> Column:
    return F.when(score >= 56, "high").when(score >= 42, "middle").otherwise("low")


def grade_tier(grade: Column) -> Column:
    out = None
    for i, c in enumerate("一二三四五", 1):
        out = F.when(grade.contains(c), i) if out is None else out.when(grade.contains(c), i)
    return out.otherwise(0)


#: The least score of each band of the rubric.
BANDS = ((68, "一类上"), (65, "一类中"), (63, "一类下"), (59, "二类上"), (55, "二类中"), (52, "二类下"), (39, "三类"), (21, "四类"), (17, "五类上"), (10, "五类中"), (0, "五类下"))


def grade_band(score: Column) -> Column:
    out = None
    for low, name in BANDS:
        out = F.when(score >= low, name) if out is None else out.when(score >= low, name)
    return out


def scaled(total: Column) -> Column:
    """From 100 points to 70, half up."""
    return F.round(total * 70 / 100)


def length_deduction(words: Column, tolerated: int = 1) -> Column:
    """None from 500 words, `tolerated` points from 400, below that one for each 50 that are missing."""
    return F.when(words >= 500, 0).when(words >= 400, tolerated).otherwise(F.ceil((400 - words) / 50))


def length_cap(words: Column) -> Column:
    return F.when(words < 400, 45).otherwise(70)


def typo_deduction(typos: Column) -> Column:
    return F.least(F.floor(typos / 3), F.lit(3))


def percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.round(100 * part / F.nullif(whole, F.lit(0))), F.lit(0))


def weak_severity(n: Column) -> Column:
    return F.when(n >= 6, "high").when(n >= 3, "medium").otherwise("low")


def bounding_box(points: Column) -> Column:
    """struct(x, y, width, height) of an array of struct(x, y)."""
    x, y = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(x).alias("x"), F.array_min(y).alias("y"), (F.array_max(x) - F.array_min(x)).alias("width"), (F.array_max(y) - F.array_min(y)).alias("height"))
