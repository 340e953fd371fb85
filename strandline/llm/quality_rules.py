"""Line-first quality cleaning, in Spark SQL expressions only.

Each line is judged on its own: a line fails when it carries navigation
(separator bars), boilerplate (fixed phrases) or bad punctuation (no sentence
end, shouting marks, symbol noise). Failing lines are removed; a document is
rejected when it fails the base limits or loses too much of its text that way.

Everything happens inside the row, so nothing is shuffled and a hot source or
group of copies has no effect. Repeated five-word windows are found by sorting
64-bit window hashes within the row, and only in rows that have any.

Defined cases: null or blank text has no words, fails the base limits and is
not kept; every input row gives one row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.cluster import only

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: A document may lose this share of its characters with the failing lines.
MAX_LOSS_PERCENT = 30
#: A line fails from this many symbols, separators or shouting marks a hundred words.
MAX_SYMBOLS_PERCENT = 30
MAX_BARS_PERCENT = 30
MAX_SHOUTS_PERCENT = 30
#: A line fails from more fixed phrases of page furniture than this a hundred words.
MAX_PHRASES_PERCENT = 2
#: Lines of up to this many words may end without a sentence mark (headings).
HEADING_WORDS = 8
#: Fixed phrases of page furniture, matched in lower case.
BOILERPLATE = ("all rights reserved", "cookie policy", "privacy policy", "terms of service", "click here", "subscribe to our newsletter", "sign up", "log in to", "javascript is disabled", "enable cookies")
_WS = "[\\x20\\x09-\\x0D]+"
_END = "[.!?:;\"')\\]\\x{2026}\\x{201D}\\x{00BB}][\\x20\\x09-\\x0D]*$"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, _WS), lambda w: w != "")


def _times(line: Column, mark: str) -> Column:
    """Non-overlapping occurrences of a mark."""
    return F.try_divide(F.char_length(line) - F.char_length(F.replace(line, F.lit(mark), F.lit(""))), F.lit(len(mark))).cast("int")


def _any(low: Column) -> Column:
    """Whether any of the fixed phrases is there: plain searches, which most lines need nothing more than."""
    hit = F.contains(low, F.lit(BOILERPLATE[0]))
    for phrase in BOILERPLATE[1:]:
        hit = hit | F.contains(low, F.lit(phrase))
    return hit


def line_fails(line: Column) -> Column:
    """True if the line breaks the punctuation, navigation or boilerplate rules; blank lines pass."""
    words = _times(line, " ") + 1
    low = F.lower(line)
    symbols = F.regexp_count(line, F.lit("[#*$%&<>]"))
    return (F.btrim(line) != "") & (
        (~line.rlike(_END) & (words > HEADING_WORDS))
        | (_times(line, "|") * 100 > words * MAX_BARS_PERCENT)
        | (_times(line, "!!") * 100 > words * MAX_SHOUTS_PERCENT)
        | (symbols * 100 > words * MAX_SYMBOLS_PERCENT)
        | F.when(_any(low), F.regexp_count(low, F.lit("|".join(BOILERPLATE))) * 100 > words * MAX_PHRASES_PERCENT).otherwise(F.lit(False))
    )


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """Base counts and verdict of every row.

    ``with_text`` adds the text without its failing lines; the input columns of ``carry`` come along,
    before the operator's own (of which clashing ones are left out), and the verdict again as verdict_kept.
    """
    kept_columns = {f"carried_{k}": c for k, c in enumerate(carry)}
    rows = only(docs, doc_id=id_col, text=text_col, **kept_columns).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("words", words_of(F.col("text"))).withColumn("lines", F.split("text", "\n"))
    rows = rows.withColumn("marks", F.transform("words", lambda w: F.xxhash64(w)))
    mark = lambda i: F.get("marks", i)
    windows = F.when(
        F.size("marks") >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size("marks") - WINDOW), lambda i: F.xxhash64(*[mark(i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("windows", windows)
    any_twice = F.size(F.array_distinct("windows")) < F.size("windows")
    ordered = F.when(any_twice, F.array_sort(F.transform("windows", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    rows = rows.withColumn("ordered", ordered)
    beside = lambda e, k: e["x"] == F.get("ordered", k)["x"]
    twice = F.array_sort(
        F.filter(
            F.transform("ordered", lambda e, k: F.when(F.coalesce(beside(e, k - 1), F.lit(False)) | F.coalesce(beside(e, k + 1), F.lit(False)), e["i"])),
            lambda i: i.isNotNull(),
        )
    )
    rows = rows.withColumn("twice", twice)
    covered = F.aggregate(
        F.transform("twice", lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get("twice", k + 1) - i, F.lit(WINDOW)))),
        F.lit(0),
        lambda a, b: a + b,
    )
    # each line is judged once, for the counts and for the cleaned text
    judged = F.transform("lines", lambda x: F.struct(x.alias("x"), x.rlike("[^\\x20\\x09-\\x0D]").alias("solid"), line_fails(x).alias("bad")))
    rows = rows.withColumn("judged", judged)
    solid = F.transform(F.filter("judged", lambda j: j["solid"]), lambda j: j["x"])
    failing = F.transform(F.filter("judged", lambda j: j["solid"] & j["bad"]), lambda j: j["x"])
    rows = rows.withColumn("solid", solid).withColumn("failing", failing)
    size = lambda lines: F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + F.char_length(x))
    counted = rows.select(
        "doc_id",
        *kept_columns,
        *(["judged"] if with_text else []),
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("solid") - F.size(F.array_distinct("solid"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("failing").cast("long").alias("n_lines_removed"),
        size("failing").alias("chars_removed"),
        size("solid").alias("line_chars"),
    )
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    verdict = counted.withColumn("base_failed", base).withColumn(
        "kept", ~F.col("base_failed") & (F.col("chars_removed") * 100 <= F.col("line_chars") * MAX_LOSS_PERCENT)
    )
    out = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed", "chars_removed"]
    cleaned = [F.array_join(F.transform(F.filter("judged", lambda j: ~j["bad"]), lambda j: j["x"]), "\n").alias("cleaned_text")] if with_text else []
    # A filter on the verdict must not be pushed below: it would put the expressions above into one another's
    # lambdas and run them once per element. Generators are a barrier to that.
    row = F.explode(F.array(F.struct(*out, *cleaned))).alias("row")
    verdict = verdict.select("doc_id", *kept_columns, row)
    own = [F.col(f"row.{c}").alias(c) for c in [*out, *(["cleaned_text"] if with_text else [])] if c not in set(carry)]
    if carry:
        return verdict.select(*[F.col(k).alias(c) for k, c in kept_columns.items()], *own, F.col("row.kept").alias("verdict_kept"))
    return verdict.select("doc_id", *own)
