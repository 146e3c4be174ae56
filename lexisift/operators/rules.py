"""Rules of character structure, as an array of errors for each text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexisift.functions.arrays import starts
from lexisift.functions.scripts import COENG, RULE_CONSONANT, RULE_DEPENDENT, RULE_MARK, RULE_VOWEL, SPACE
from lexisift.functions.text import held

# The whole-syllable patterns that need no further check.
_C, _V, _D = r"[\x{1780}-\x{17A3}]", r"[\x{17B6}-\x{17D3}]", r"[\x{17C6}-\x{17D3}]"
WHOLE = rf"^{_C}(?:{_V}|{_D}|{COENG}{_C}|{_V}{_D}|{COENG}{_C}{_V})?\n?\z"


def _error(position: Column, length: Column | int, kind: str, severity: str = "error") -> Column:
    return F.struct(position.cast("int").alias("position"), (F.lit(length) if isinstance(length, int) else length).cast("int").alias("length"), F.lit(kind).alias("type"), F.lit(severity).alias("severity"))


MARK = "\x01\x02\x01"
ERRORS = "array<struct<position:int,length:int,type:string,severity:string>>"


def syllable_errors(x: Column, at: Column) -> Column:
    """The errors of one odd syllable that begins at ``at``: orphaned marks, misplaced coeng, several vowels."""
    base = lambda c: c.rlike(f"^[{RULE_CONSONANT}]")

    def of(a: Column) -> Column:
        n = F.size(a)
        alone = F.array(F.when((n == 1) & x.rlike(f"^[{RULE_MARK}]"), _error(at, 1, "orphaned_combining_mark")))

        def coeng(c: Column, i: Column) -> Column:
            last, first = i + 1 >= n, i == 0
            after = F.when(last | ~base(F.try_element_at(a, i + 2)), _error(at + i, F.when(last, 1).otherwise(2), "invalid_coeng_usage"))
            before = F.when(first | ~base(F.try_element_at(a, F.greatest(i, F.lit(1)))), _error(at + F.greatest(i - 1, F.lit(0)), F.when(first, 1).otherwise(2), "invalid_coeng_usage"))
            return F.when(c == "\u17d2", F.array(after, before)).otherwise(F.array().cast(ERRORS))

        vowels = F.filter(F.transform(a, lambda c, k: F.when(c.rlike(f"^[{RULE_DEPENDENT}]"), k)), lambda k: k.isNotNull())
        several = F.transform(F.array(vowels), lambda v: F.when(F.size(v) > 1, _error(at + F.array_min(v), F.array_max(v) - F.array_min(v) + 1, "invalid_vowel_combination", "warning")))
        return F.array_compact(F.concat(alone, F.flatten(F.transform(a, coeng)), several))

    return F.flatten(F.transform(F.array(F.regexp_extract_all(x, F.lit(r"(?s)."), 0)), of))


def borders(text: Column, pattern: str) -> Column:
    """The places just before which an empty pattern matches, by the lengths of the pieces between."""
    pieces = F.transform(F.array(F.split(text, pattern)), lambda p: F.slice(starts(F.transform(p, F.length)), 2, F.greatest(F.size(p) - 1, F.lit(0))))
    return F.get(pieces, F.lit(0))


def sequence_errors(text: Column) -> Column:
    """The errors of adjacent characters: a mark after no base, two coengs."""
    text = F.coalesce(text, F.lit(""))
    lost = borders(text, rf"(?<=[^{RULE_CONSONANT}{RULE_VOWEL}{SPACE}])(?=[{RULE_MARK}])")
    double = borders(text, rf"(?<={COENG})(?={COENG})")
    return F.concat(F.transform(lost, lambda i: _error(i - 1, 2, "invalid_character_sequence")), F.transform(double, lambda i: _error(i - 1, 2, "invalid_unicode_sequence")))


def with_errors(df: DataFrame, text: str, syllables: Column | None, name: str = "rule_errors") -> DataFrame:
    """``df`` with all rule errors of each text, of its syllables (if any are given) and of adjacent characters.

    Rows are judged one by one and nothing is shuffled, so rows that repeat a key do not mix. Blank syllables and those
    of a known shape have no error, nor have those without marks, vowels or coengs; they are left out before anything
    is taken apart. Places are in the text.
    """
    found = sequence_errors(F.col(text))
    if syllables is None:
        return df.withColumn(name, found)
    df = held(df, name, syllables)
    odd = lambda x: x.rlike(f"[{RULE_MARK}{RULE_DEPENDENT}]") & ~x.rlike(WHOLE) & x.rlike(f"[^{SPACE}]")
    # Odd syllables are set off by a mark that no text has; the pieces between marks, few as they are, give the places.
    joined = F.array_join(F.transform(name, lambda x: F.when(odd(x), F.concat(F.lit(MARK), x, F.lit(MARK))).otherwise(x)), "")
    pieces = F.when(F.contains(text, F.lit(MARK)), F.flatten(F.transform(name, lambda x: F.when(odd(x), F.array(F.lit(""), x)).otherwise(F.array(x, F.lit("")))))).otherwise(F.split(joined, MARK))
    df = held(df, name, pieces)
    placed = F.zip_with(name, starts(F.transform(name, F.length)), lambda x, at: F.struct(x.alias("x"), at.alias("at")))
    every_second = F.filter(placed, lambda z, i: i % 2 == 1)
    return df.withColumn(name, F.concat(F.flatten(F.transform(every_second, lambda z: syllable_errors(z["x"], z["at"]))), found))


def error_rows(texts: DataFrame, key: str, text: str, syllables: Column | None) -> DataFrame:
    """(key, position, length, type, severity) of all errors; ``syllables`` None checks adjacent characters alone."""
    each = with_errors(texts.select(key, text), text, syllables).select(key, F.explode("rule_errors").alias("e"))
    return each.select(key, F.col("e.position").cast("bigint").alias("position"), F.col("e.length").cast("bigint").alias("length"), "e.type", "e.severity")


def sequence_rows(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Error rows of adjacent characters."""
    return error_rows(texts, key, text, None)


def with_rule_scores(df: DataFrame, text: str, errors: str = "rule_errors") -> DataFrame:
    """``df`` with size, n_errors, n_warnings, rule_score and is_valid of each text from its errors."""
    n = lambda kind: F.size(F.filter(errors, lambda e: e["severity"] == kind)).cast("bigint")
    out = df.withColumns({"size": F.coalesce(F.length(text), F.lit(0)), "n_errors": n("error"), "n_warnings": n("warning")})
    score = F.greatest(F.lit(0.0), 1 - (2.0 * F.col("n_errors") + F.col("n_warnings")) / F.greatest("size", F.lit(1)))
    return out.withColumns({"rule_score": score, "is_valid": F.col("n_errors") == 0})


def rule_summary(texts: DataFrame, key: str, text: str, syllables: Column | None) -> DataFrame:
    """(key, size, n_errors, n_warnings, rule_score, is_valid) of each text."""
    out = held(with_errors(texts.select(key, text), text, syllables), "rule_errors", F.col("rule_errors"))
    return with_rule_scores(out, text).select(key, "size", "n_errors", "n_warnings", "rule_score", "is_valid")


def batch_statistics(texts: DataFrame, text: str, syllables: Column | None) -> DataFrame:
    """One row over all texts: n_texts, n_valid, n_errors, n_warnings, mean_score, valid_rate and the errors by type, most first."""
    scored = with_rule_scores(held(with_errors(texts.select(text), text, syllables), "rule_errors", F.col("rule_errors")), text)
    kinds = scored.select(F.explode("rule_errors.type").alias("type")).groupBy("type").agg(F.count("*").alias("n"))
    # A row for each type of error, of which there are six.
    by_type = kinds.agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "type"))), lambda x: F.struct(x["type"].alias("type"), (-x["less"]).alias("n"))).alias("by_type"))
    valid = F.count_if("is_valid")
    totals = scored.agg(F.count("*").alias("n_texts"), valid.alias("n_valid"), F.sum("n_errors").alias("n_errors"), F.sum("n_warnings").alias("n_warnings"), F.avg("rule_score").alias("mean_score"), (valid / F.count("*")).alias("valid_rate"))
    return totals.crossJoin(F.broadcast(by_type))  # one row is broadcast
