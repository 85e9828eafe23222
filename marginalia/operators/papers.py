"""Exam papers: questions and marks, validation, keep/skip split, batches, attached analyses, session roll-ups, text blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.columns import answer_letter, falsy, has_stem, inferred_answer, marked, normalise_error_type, option_of, or_blank
from marginalia.operators import runs
from marginalia.sources.tables import first_of


def merge_marks(questions: DataFrame, marks: DataFrame, keys: list[str], number: str = "number") -> DataFrame:
    """Questions with the last mark (by pos) of their number; a question without a number is never classified and stays correct.

    questions: keys, number, student_answer, correct_answer, options and, if they are known, the texts of their blocks;
    marks: keys, number, pos, mark, answer, extra. A marked question without an answer has the one that its later blocks
    show, before it is told whether it was answered.
    """
    last = marks.groupBy(*keys, number).agg(F.max(F.struct("pos", "mark", "answer", "extra")).alias("m"))
    q = questions.join(last, [*keys, number], "left")
    mark, found = F.coalesce("m.mark", F.lit("")), F.col("m").isNotNull()
    judged = F.when(F.col(number).isNotNull() & (F.col(number) != 0), marked(mark, found))
    q = q.withColumn("j", judged)
    note = F.array_join(F.filter(F.array("m.mark", "m.answer", "m.extra"), lambda x: or_blank(x, "") != ""), " ")
    given = or_blank(F.col("m.answer"), F.lit(None))
    corrected = F.when(found & ~F.col("j.is_correct") & (F.col("j.confidence") == "high") & given.isNotNull(), option_of(F.coalesce("options", F.array().cast("array<string>")), given)).otherwise(F.col("correct_answer"))
    out = q.withColumns(
        {
            "is_correct": F.coalesce("j.is_correct", F.lit(True)), "confidence": F.col("j.confidence"), "grading_mark": F.col("j.grading_mark"),
            "has_red_ink": F.col("j.has_red_ink"), "red_ink": F.when(found, note).otherwise(F.lit("")), "correct_answer": corrected,
        }
    )
    blank = or_blank(F.col("student_answer"), "") == ""
    if "blocks" in questions.columns:
        out = out.withColumn("student_answer", F.when(blank & found & F.col("j").isNotNull(), F.coalesce(inferred_answer(F.col("blocks")), F.col("student_answer"))).otherwise(F.col("student_answer")))
    return out.withColumn("is_unanswered", blank & ~F.col("is_correct")).drop("j", "m")


def merge_counts(merged: DataFrame, keys: list[str]) -> DataFrame:
    return merged.groupBy(*keys).agg(
        F.count_if("is_correct").alias("correct"), F.count_if(~F.col("is_correct")).alias("wrong"), F.count_if("is_unanswered").alias("unanswered"),
        F.count_if(or_blank(F.col("student_answer"), "") != "").alias("answered"),
    )


def validated(rows: DataFrame) -> DataFrame:
    """Six rules in order, each seeing what those before corrected; adds issues, is_correct, student_answer, confidence and valid."""
    mark, ink = or_blank(F.col("grading_mark"), ""), or_blank(F.col("red_ink"), "")
    answer = F.when((F.col("question_type") == "选择题") & (or_blank(F.col("student_answer"), "") != ""), answer_letter(F.col("student_answer"))).otherwise(F.col("student_answer"))
    r = rows.withColumns({"student_answer": answer, "is_unanswered": F.coalesce("is_unanswered", F.lit(False)), "_c0": F.col("is_correct")})
    says = lambda hit, text: F.when(F.coalesce(hit, F.lit(False)), text)
    both = (or_blank(F.col("student_answer"), "") != "") & (or_blank(F.col("correct_answer"), "") != "")
    r = r.withColumn("_3", (ink != "") & both & (F.col("student_answer") != F.col("correct_answer")) & F.col("_c0"))
    r = r.withColumn("_c3", F.when(F.col("_3"), False).otherwise(F.col("_c0")))
    r = r.withColumn("_4", mark.rlike(r"-\d") & F.col("_c3")).withColumn("_c4", F.when(F.col("_4"), False).otherwise(F.col("_c3")))
    r = r.withColumn("_5", F.col("is_unanswered") & ~F.coalesce("has_red_ink", F.lit(False)) & F.col("_c4"))
    r = r.withColumn("is_correct", F.when(F.col("_5"), False).otherwise(F.col("_c4")))
    issues = F.filter(
        F.array(
            says(F.col("number").isNull(), "缺少题号"), says(F.col("_c0").isNull(), "缺少对错判断"),
            says(F.col("_3"), F.concat(F.lit("矛盾：红笔正确答案="), F.col("correct_answer"), F.lit("但标记为正确"))), says(F.col("_4"), "矛盾：有扣分标记但标记为正确"), says(F.col("_5"), "未作答但标记为正确"),
        ),
        lambda x: x.isNotNull(),
    )
    confidence = or_blank(F.col("confidence"), F.when(mark != "", "high").otherwise("medium"))
    return r.withColumns({"issues": issues, "confidence": confidence, "valid": F.size(issues) == 0}).drop("_c0", "_3", "_c3", "_4", "_c4", "_5")


def validation_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("flagged"),
        F.count_if(~F.col("is_correct") & ~F.col("is_unanswered")).alias("wrong"), F.count_if("is_unanswered").alias("unanswered"),
    )


def kept_and_skipped(wrong: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Wrong questions with a stem, and rows for those without: a fixed text, type and note, difficulty as the store's default makes of 0."""
    stem = has_stem(F.col("question_text"))
    kind = or_blank(F.col("question_type"), "听力")
    skipped = wrong.where(~stem).withColumns(
        {
            "topic": F.concat(F.lit("第"), F.col("number").cast("string"), F.lit("题（"), kind, F.lit("）")), "question_text": F.lit("(无题干，听力题)"), "question_type": kind,
            "error_type": F.lit("听力题无题干"), "difficulty": falsy(F.lit(0), 0, 3), "notes": F.lit("听力题自动跳过"),
        }
    )
    return wrong.where(stem), skipped


def batched(rows: DataFrame, keys: list[str], order: list[Column], size: int = 8) -> DataFrame:
    """Each row's batch of its paper (from 0) and its number in the batch (from 1)."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return rows.withColumn("_n", n).withColumns({"batch": F.floor(F.col("_n") / size).cast("long"), "place": (F.col("_n") % size + 1).cast("long")}).drop("_n")


# What stands for a blank field of a question, in the store's rows and in a prompt.
BLANKS = {"question_type": "未知题型", "question_text": "", "student_answer": "", "correct_answer": "", "grading_mark": "", "red_ink": "", "confidence": "high"}
SHOWN = {"student_answer": "（未作答）", "correct_answer": "（待分析）", "grading_mark": "无", "red_ink": "无", "confidence": "high", "question_type": "未知题型", "question_text": ""}


def page_questions(pages: DataFrame, keys: list[str], page: str = "page", questions: str = "questions") -> DataFrame:
    """The questions of all pages as rows, each with the index of its page; pages without questions give none."""
    return pages.select(*keys, page, F.explode(questions).alias("q")).select(*keys, F.col(page), "q.*")


def normalised(wrong: DataFrame) -> DataFrame:
    """Wrong questions with the fields of a prompt, none of them blank where there is a default; the text falls back to raw_text."""
    have = {c: F.col(c) for c in wrong.columns}
    text = or_blank(have.get("question_text", F.lit("")), have.get("raw_text", F.lit("")))
    fields = {n: or_blank(have.get(n, F.lit(None).cast("string")), blank) for n, blank in BLANKS.items()}
    options = F.coalesce(have.get("options", F.lit(None)), F.array().cast("array<string>"))
    return wrong.withColumns(fields | {"question_text": or_blank(text, ""), "options": options})


def question_block(place: Column) -> Column:
    """The lines of one question in a prompt."""
    show = {n: or_blank(F.col(n), blank) for n, blank in SHOWN.items()}
    options = F.when(F.size("options") > 0, F.concat(F.lit("\n  选项："), F.array_join("options", " | "))).otherwise("")
    return F.concat(
        F.lit("【错题 "), place.cast("string"), F.lit("】原题号第"), F.col("number").cast("string"), F.lit("题（"), show["question_type"], F.lit("）\n  题目："), show["question_text"], options,
        F.lit("\n  学生作答："), show["student_answer"], F.lit("\n  正确答案："), show["correct_answer"], F.lit("\n  批改标记："), show["grading_mark"],
        F.lit("\n  红笔批注："), show["red_ink"], F.lit("\n  置信度："), show["confidence"],
    )


def rendered(batches: DataFrame, keys: list[str]) -> DataFrame:
    """One text for each batch: a block of lines for each question in order."""
    texts = F.sort_array(F.collect_list(F.struct("place", question_block(F.col("place")).alias("text"))))  # of one batch
    return normalised(batches).groupBy(*keys, "batch").agg(F.array_join(F.transform(texts, lambda t: t["text"]), "\n\n").alias("text"), F.count("*").alias("n"))


def card_map(cards: Column, concept: str, text: str) -> Column:
    """map of concept to text; of cards with one concept the last counts."""
    last = F.filter(cards, lambda c, i: ~F.exists(F.slice(cards, i + 2, F.size(cards)), lambda later: later[concept] == c[concept]))
    return F.map_from_entries(F.transform(last, lambda c: F.struct(c[concept], c[text])))


def with_analysis(wrong: DataFrame, analyses: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Wrong questions with the first analysis of their number; types normalised, difficulty within 1 to 5."""
    first = first_of(analyses, [*keys, "number"], order).select(*keys, "number", F.col("error_type").alias("a_type"), F.col("difficulty").alias("a_difficulty"), F.lit(True).alias("analysed"))
    out = wrong.join(first, [*keys, "number"], "left")
    return out.withColumns(
        {
            "error_type": normalise_error_type(F.col("a_type"), F.col("student_answer")), "analysed": F.coalesce("analysed", F.lit(False)),
            "difficulty": F.least(F.lit(5), F.greatest(F.lit(1), falsy(F.col("a_difficulty"), 0, 3))).cast("long"),
        }
    ).drop("a_type", "a_difficulty")


def grouped_blocks(blocks: DataFrame, page: str = "page", gap: int = 50, left: int = 200, least: float = 0.3) -> DataFrame:
    """(page, y, x, text, grp): blocks in reading order, their group counted from 1; heights aren't negative.

    A numbered text at the left opens a group, as does a block `gap` or more from the group's bottom, which is the
    greatest so far within the group. A block that much above the bottom is so above the bottom of the very block before
    it, since those between are in order; so it opens a group whatever came earlier, as numbered ones do. From such a
    block on, groups that open further down leave all bottoms before them above, so the bottom is a running maximum, and
    no row waits for the one before. Pages are dealt over parts (operators.runs): of an open page, blocks before the first
    that opens a group by itself are fewer groups by those that the bottom handed down still reaches.
    """
    text = F.trim("text")
    rows = blocks.where((F.col("confidence") >= least) & (text != "")).select(page, F.col("y").cast("long"), F.col("x").cast("long"), F.col("height").cast("long"), text.alias("text"))
    rows = rows.select(runs.key_text(F.col(page)).alias("key"), "y", "x", "height", "text", (F.col("text").rlike(r"^\d+[.、\s]") & (F.col("x") < left)).alias("opens"), page)
    kind = blocks.schema[page].dataType.simpleString()
    names = [page, "y", "x", "text", "k", "part", "lead", "saying"]

    def fold(batches, part):
        import numpy as np
        import pyarrow as pa

        said_type = pa.struct([("first", pa.string()), ("last", pa.string()), ("one", pa.bool_()), ("numbers", pa.list_(pa.int64())), ("lists", pa.list_(pa.list_(pa.int64())))])
        first = last = kept_type = None
        under = top = count = 0  # the block before: its bottom, the greatest since a group opened by itself, its group
        led, fronts, highest, opened, begin = True, [], 0, False, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(0).dictionary_encode().indices.to_numpy()
            y, bottom = batch.column(1).to_numpy(), batch.column(1).to_numpy() + batch.column(3).to_numpy()
            own = batch.column(0)[0].as_py()
            new = np.r_[own != last, keys[1:] != keys[:-1]]
            certain = new | batch.column(5).to_numpy(zero_copy_only=False).astype(bool) | (np.r_[under, bottom[:-1]] - y >= gap)
            # Running maxima by segments: each lies above all of the one before.
            low, high = min(int(bottom.min()), top), max(int(bottom.max()), top)
            lift = np.cumsum(certain) * (high - low + 1)
            reached = np.maximum.accumulate(np.r_[top, bottom + lift])[:-1]
            fresh = certain | (y + lift - reached >= gap)
            most = np.maximum.accumulate(np.r_[top, bottom + lift])[-1] - lift[-1]
            groups = np.cumsum(fresh)
            base = np.maximum.accumulate(np.where(new, groups - 1, -count if not new[0] else 0))
            k = groups - base
            if first is None:
                first, opened, begin = own, bool(batch.column(5)[0].as_py()), int(y[0])
            front = np.cumsum(new) == (1 if own != last else 0) if own == first else np.zeros(n, bool)  # rows of the open page
            if not led or not front.any():
                lead = np.zeros(n, bool)
            else:
                inner = certain.copy()
                inner[0] &= last is not None  # the part's first block opens a group by what stood before it
                lead = front & (np.cumsum(inner) == 0)
                led = bool(lead[-1])
                fronts.append(y[lead & fresh])
            if front.any():
                highest = max([int(bottom[front].max()), *([highest] if last is not None else [])])
            last, under, top, count = batch.column(0)[n - 1].as_py(), int(bottom[-1]), int(most), int(k[-1])
            kept_type = batch.column(6).type
            yield pa.RecordBatch.from_arrays([batch.column(6), batch.column(1), batch.column(2), batch.column(4), pa.array(k), pa.array(np.full(n, part, np.int32)), pa.array(np.where(front, np.where(lead, 2, 1), 0).astype(np.int32)), pa.nulls(n, said_type)], names)
        if first is not None:
            reach = np.concatenate(fronts).tolist() if fronts else []
            said = {"first": first, "last": last, "one": first == last, "numbers": [under, top, count, highest, int(led), int(opened), begin], "lists": [reach]}
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kept_type), *(pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.string(), pa.int64())), pa.array([part], pa.int32()), pa.nulls(1, pa.int32()), pa.array([said], said_type)], names)

    def less(numbers, reach, given):
        """How many of the leading groups are none, the bottom handed down reaching them."""
        import bisect

        return 0 if numbers[5] or given[0] - numbers[6] >= gap else bisect.bisect_left(reach, given[1] + gap)

    def follow(numbers, lists, given):
        under, top, count, highest, led, opened, begin = numbers
        if given is None:
            return [under, top, count]
        own = not (opened or given[0] - begin >= gap)
        return [under, max(given[1], highest) if led and own else top, given[2] + count - less(numbers, lists[0], given)]

    def shifts(batches):
        import pyarrow as pa

        for batch in batches:
            out = [None if given is None else [given[2], less(said["numbers"], said["lists"][0], given)] for said, given in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x and x[0] for x in out], pa.int64()), pa.array([x and x[1] for x in out], pa.int64())], ["part", "base", "less"])

    schema = f"{page} {kind}, y long, x long, text string, k long, part int, lead int, saying {runs.SAYING}"
    parts = runs.in_parts(rows, ["key", "y", "x", "height", "text"], fold, schema, "blocks")
    given = parts.where("saying is not null").select("part", "saying").join(runs.handed(parts, follow, 3), "part")
    shift = given.mapInArrow(shifts, "part int, base long, less long").where("base is not null")
    out = parts.where("saying is null").join(F.broadcast(shift), "part", "left")  # a row for each part at most
    lead = F.when(F.col("lead") == 2, F.least("k", "less")).otherwise(F.col("less"))
    grp = F.when((F.col("lead") == 0) | F.col("base").isNull(), F.col("k")).otherwise(F.col("base") + F.col("k") - lead)
    return out.select(page, "y", "x", "text", grp.alias("grp"))


def first_places(text: str, lines: list[str], gram: int = 16) -> list[int]:
    """Where each line is found first in text, in which all of them stand in order.

    A line can only be found before its own place where its first characters stand, so the places of grams are sorted once
    and a line is compared at those of its own gram, which for most lines is its own place; equal lines are looked up once.
    """
    import numpy as np

    known: dict[str, int] = {}
    if len(lines) <= 64:
        return [known[x] if x in known else known.setdefault(x, text.find(x)) for x in lines]
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    grams = np.zeros(max(0, len(codes) - gram + 1), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(gram):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + len(grams)]
    order = np.argsort(grams, kind="stable")
    ordered = grams[order]
    at = 0
    for x in lines:
        at = text.index(x, at)  # no later than its own place
        if x not in known:
            known[x] = at
            if len(x) < gram:
                known[x] = text.find(x, 0, at + len(x))
                continue
            k = int(np.searchsorted(ordered, grams[at], "left"))
            while order[k] < at and not text.startswith(x, order[k]):
                k += 1
            known[x] = min(int(order[k]), at)
        at += len(x)
    return [known[x] for x in lines]


def paragraphs(texts: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, line, start, body): lines that aren't blank; start is where the same line is found first in the text."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lines = [[x for x in (t or "").split("\n") if x.strip(" ")] for t in batch.column(1).to_pylist()]
            starts = [first_places(t or "", ls) for t, ls in zip(batch.column(1).to_pylist(), lines)]
            found = [[{"line": i, "start": s, "body": x} for i, (s, x) in enumerate(zip(ss, ls))] for ss, ls in zip(starts, lines)]
            line = pa.struct([("line", pa.int64()), ("start", pa.int64()), ("body", pa.string())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(line))], [key, "lines"])

    found = texts.select(key, text).mapInArrow(run, f"{key} {kind}, lines array<struct<line: bigint, start: bigint, body: string>>")
    return found.select(key, F.inline("lines"))


def segments(lines: DataFrame, notes: DataFrame, key: str = "id", bin_size: int = 1024) -> DataFrame:
    """(key, line, begin, end, kind): annotated and plain stretches of each paragraph, positions within the line.

    notes: key, start, end, kind. A note belongs to every paragraph that holds it whole; gaps before, between and after are
    plain. Lines go to every bin of positions that they reach, notes to the one where they start, so notes meet only lines
    of their own stretch of the text.
    """
    n = notes.withColumnRenamed("start", "n_start").withColumnRenamed("end", "n_end")
    size = F.length("body").cast("long")
    bin_of = lambda at: F.floor(at / bin_size)
    spans = lines.select(key, "line", "start", (F.col("start") + size).alias("stop")).withColumn("bin", F.explode(F.sequence(bin_of(F.col("start")), bin_of(F.col("stop")))))
    held = spans.join(n.withColumn("bin", bin_of(F.col("n_start"))), [key, "bin"]).where((F.col("n_start") >= F.col("start")) & (F.col("n_end") <= F.col("stop")))
    w = Window.partitionBy(key, "line").orderBy("n_start", "n_end")
    at = held.withColumns({"begin": F.col("n_start") - F.col("start"), "end": F.col("n_end") - F.col("start")}).withColumn("before", F.lag("end", 1, 0).over(w))
    stretch = lambda begin, end, kind: F.struct(begin.alias("begin"), end.alias("end"), kind.alias("kind"))
    plain = stretch(F.col("before"), F.col("begin"), F.lit("normal"))
    own = at.select(key, "line", F.inline(F.filter(F.array(stretch(F.col("begin"), F.col("end"), F.col("kind")), F.when(F.col("begin") > F.col("before"), plain)), lambda x: x.isNotNull())))
    last = at.groupBy(key, "line").agg(F.max_by("end", F.struct("n_start", "n_end")).alias("reached"))
    rest = lines.select(key, "line", size.alias("end")).join(last, [key, "line"], "left").withColumn("begin", F.coalesce("reached", F.lit(0).cast("long"))).where("begin < end")
    return own.unionByName(rest.select(key, "line", "begin", "end", F.lit("normal").alias("kind")))
