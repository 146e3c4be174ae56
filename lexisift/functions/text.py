"""Column functions: cleaning, ratios, quality scores, classes. All are null-safe: null text counts as empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexisift.functions.scripts import DIGIT, SCRIPT, SPACE

_S = SPACE


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def held(df: DataFrame, name: str, c: Column) -> DataFrame:
    """``df`` with a column that is computed once, however often later expressions and lambdas name it."""
    return df.select(*(x for x in df.columns if x != name), F.explode(F.array(c)).alias(name))


def sub(c: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(to))


#: Python's white space, the characters of ``SPACE``.
BLANKS = "\t\n\x0b\f\r \x1c\x1d\x1e\x1f\x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column | str) -> Column:
    """Without white space at both ends, as Python's strip."""
    return F.btrim(col(c), F.lit(BLANKS))


def steps(c: Column, *each: tuple[str, str, str]) -> Column:
    """``c`` through steps (mark, pattern, replacement) in turn; a text without the mark is left as it is.

    A column that a step names twice is bound by a lambda, so it is computed once.
    """

    def one(mark: str, pattern: str, to: str):
        return lambda x: F.when(F.contains(x, F.lit(mark)), sub(x, pattern, to)).otherwise(x) if mark else sub(x, pattern, to)

    out = F.array(c)
    for step in each:
        out = F.transform(out, one(*step))
    return F.get(out, F.lit(0))


# Patterns below never look twice at a run that has no end: what follows an opening sign up to where its end would have
# to be is taken as a whole, and put back by the group of the second branch.
_BRACKETS = (("[", r"\[[^\n\]]*+\]|(\[[^\n\]]*+)", "$1"), ("(", r"\([^\n)]*+\)|(\([^\n)]*+)", "$1"))


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def clean_markup(c: Column | str) -> Column:
    """Without tags, named and decimal entities, and javascript: and mailto: remains."""
    return strip(
        steps(
            F.coalesce(col(c), F.lit("")),
            ("<", r"<[^>]++>|(<[^>]*+\z)", "$1"),
            ("&", r"&[a-zA-Z]++;", ""),
            ("&#", r"&#\p{Nd}++;", ""),
            ("javascript:", r"javascript:[^\n;]*+;|(javascript:[^\n;]*+)", "$1"),
            ("mailto:", rf"mailto:[^{_S}>]*+[{_S}>]|(mailto:[^{_S}>]*+\z)", "$1"),
        )
    )


def clean_unicode(c: Column | str, nfc: bool = True) -> Column:
    """NFC, no zero-width space or mark, plain spaces."""
    from lexisift.functions.udfs import nfc as compose

    c = col(c)
    if nfc:
        c = compose(c)
    return F.translate(c, "\u00a0\u200b\ufeff", " ")


def clean_unwanted(c: Column | str, brackets: bool = True) -> Column:
    """Without bracketed parts, addresses and phone-like runs; long runs of marks shortened."""
    return strip(
        steps(
            col(c),
            *(_BRACKETS if brackets else ()),
            ("://", r"https?://[!$-_a-z]++", ""),
            # A run without white space goes as a whole if an @ and a later dot have something before, between and after them.
            ("@", rf"[^{_S}][^{_S}@]*+@[^{_S}][^{_S}.]*+\.[^{_S}]++|([^{_S}]++)", "$1"),
            ("", rf"\+?[\p{{Nd}}{_S}\-()]{{10,}}+", ""),
            ("...", r"[.]{3,}+", "..."),
            ("!!", r"!{2,}+", "!"),
            ("??", r"\?{2,}+", "?"),
        )
    )


def clean_space(c: Column | str) -> Column:
    return strip(sub(col(c), rf"[{_S}]++", " "))


def clean_text(c: Column | str, nfc: bool = True) -> Column:
    """The full cleaning chain: markup, characters, unwanted parts, white space."""
    return clean_space(clean_unwanted(clean_unicode(clean_markup(c), nfc)))


def clean_scraped(c: Column | str) -> Column:
    """Cleaning of scraped pages: white space first, so gaps left by brackets stay."""
    c = sub(F.coalesce(col(c), F.lit("")), rf"[{_S}]++", " ")
    return strip(steps(c, *_BRACKETS))


def normal_form(c: Column | str) -> Column:
    """For comparing texts: lower case, single spaces, letters, digits and script characters alone."""
    return sub(sub(strip(F.lower(F.coalesce(col(c), F.lit("")))), rf"[{_S}]++", " "), rf"[^\p{{L}}\p{{N}}_{_S}{SCRIPT}]")


def model_text(c: Column | str, least: float = 0.0, spaces: bool = True) -> Column:
    """Script characters (and white space) of a text whose share of them among non-space characters reaches ``least``; else empty."""
    c = F.coalesce(col(c), F.lit(""))
    ratio = F.coalesce(count(c, f"[{SCRIPT}]") / F.nullif(count(c, rf"[^{_S}]"), F.lit(0)), F.lit(-1.0))
    return F.when(ratio < least, F.lit("")).otherwise(sub(c, rf"[^{SCRIPT}{_S if spaces else ''}]"))


def script_ratio(c: Column | str) -> Column:
    """Script characters to letters; 0 without letters. Marks are no letters, so it may exceed 1."""
    c = col(c)
    return F.coalesce(count(c, f"[{SCRIPT}]") / F.nullif(count(c, r"\p{L}"), F.lit(0)), F.lit(0.0))


def latin_ratio(c: Column | str) -> Column:
    c = col(c)
    return F.coalesce(count(c, r"[A-Za-z\x{130}\x{212A}]") / F.nullif(count(c, r"\p{L}"), F.lit(0)), F.lit(0.0))


def char_ratio(c: Column | str) -> Column:
    """Script characters to all characters."""
    c = col(c)
    return F.coalesce(count(c, f"[{SCRIPT}]") / F.nullif(F.length(c), F.lit(0)), F.lit(0.0))


def good_encoding(c: Column | str) -> Column:
    """No replacement character and no run of 20 script characters; not empty."""
    return (F.length(col(c)) > 0) & ~col(c).rlike(rf"\x{{FFFD}}|[{SCRIPT}]{{20}}")


def words(c: Column | str) -> Column:
    return F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(rf"[^{_S}]+"), 0)


def with_quality(df: DataFrame, text: str, least_ratio: float = 0.6, least_length: int = 50) -> DataFrame:
    """``df`` with the metrics of a text, its latin_ratio and its quality_score. Each pattern is counted once."""
    c = F.coalesce(F.col(text), F.lit(""))
    counts = {"n": F.length(c), "script": count(c, f"[{SCRIPT}]"), "letters": count(c, r"\p{L}"), "latin": count(c, r"[A-Za-z\x{130}\x{212A}]"), "w": count(c, rf"[^{_S}]+"), "solid": count(c, rf"[^{_S}]"), "ends": count(c, r"[.!?]+"), "good": good_encoding(c)}
    out = held(df, "_m", F.struct(*(v.alias(k) for k, v in counts.items())))
    x = lambda k: F.col(f"_m.{k}")
    n, w, good = x("n"), x("w"), x("good")
    share = lambda k: F.coalesce(x(k) / F.nullif(x("letters"), F.lit(0)), F.lit(0.0))
    ratio = share("script")
    sentences = F.when(n == 0, 0).otherwise(F.greatest(x("ends"), F.lit(1)))
    mean = x("solid") / F.greatest(w, F.lit(1))
    per = w / F.greatest(sentences, F.lit(1))
    score = (
        F.when(ratio >= least_ratio, 0.3 * F.least(ratio / 0.8, F.lit(1.0))).otherwise(0.0)
        + F.when(n >= least_length, 0.2 * F.least(n / 500, F.lit(1.0))).otherwise(0.0)
        + F.when(w > 0, 0.2 * F.least(w / F.greatest(n, F.lit(1)) * 10, F.lit(1.0))).otherwise(0.0)
        + F.when((n > 0) & per.between(5, 25), 0.15).otherwise(0.0)
        + F.when(mean.between(3, 15), 0.1).otherwise(0.0)
        + F.when(good, 0.05).otherwise(0.0)
    )
    metrics = {
        "length": n.cast("bigint"),
        "word_count": w.cast("bigint"),
        "sentence_count": sentences.cast("bigint"),
        "khmer_ratio": ratio,
        "latin_ratio": share("latin"),
        "avg_word_length": mean,
        "has_proper_encoding": good,
        "quality_score": F.least(score, F.lit(1.0)),
    }
    return out.withColumns(metrics).drop("_m")


def reject_reason(least_ratio: float = 0.6, least_length: int = 50, most_latin: float = 0.3) -> Column:
    """Why a text is not accepted, by its metrics, first reason first; null if it is."""
    return (
        F.when(F.col("length") < least_length, "length")
        .when(F.col("khmer_ratio") < least_ratio, "khmer_ratio")
        .when(~F.col("has_proper_encoding"), "encoding")
        .when(F.col("latin_ratio") > most_latin, "khmer_ratio")
        .when(F.col("quality_score") < 0.5, "quality")
    )


def high_quality(score: Column, least: float = 0.7) -> Column:
    """Whether a quality score is high."""
    return score >= least


def mostly_script(c: Column | str, least: float = 0.5) -> Column:
    """Whether at least half of all characters, white space counted, are of the script; not for empty texts."""
    return (F.length(col(c)) > 0) & (char_ratio(c) >= least)


def complexity(c: Column | str) -> Column:
    """The mean of a text's length, to a hundred characters at most, and the share of its characters that are distinct; 0 for empty texts."""
    c = F.coalesce(col(c), F.lit(""))
    n = F.length(c)
    distinct = F.size(F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?s)."), 0)))
    return F.when(n == 0, 0.0).otherwise((F.least(n / 100, F.lit(1.0)) + distinct / n) / 2)


def restored(c: Column | str) -> Column:
    """A text whose tokens are parted by single spaces put together again; double spaces stay."""
    mark = F.lit("<<<DOUBLE_SPACE>>>")
    return F.replace(F.replace(F.replace(col(c), F.lit("  "), mark), F.lit(" "), F.lit("")), mark, F.lit("  "))


def number_type(c: Column | str) -> Column:
    c = strip(c)
    return (
        F.when(~c.rlike(rf"^[{DIGIT}0-9]+\z"), "not_number")
        .when(F.length(c) == 1, F.when(c.rlike(f"[{DIGIT}]"), "single_khmer").otherwise("single_arabic"))
        .when(c.rlike(f"[{DIGIT}]") & c.rlike("[0-9]"), "mixed_digits")
        .when(c.rlike(f"[{DIGIT}]"), "multi_khmer")
        .otherwise("multi_arabic")
    )


#: Fixed value: marks that count as punctuation besides the ASCII ones.
MARK_LIST = "។៕៖ៗ៘៙៚៛ៜ៝៞៟"
PUNCTUATION = r"!-/:-@\[-`{-~" + MARK_LIST


def syllable_type(c: Column | str) -> Column:
    """empty, punctuation, number, khmer, mixed or non_khmer."""
    s = strip(c)
    return (
        F.when(s == "", "empty")
        .when(s.rlike(rf"^[{PUNCTUATION}{_S}]+\z"), "punctuation")
        .when(s.rlike(rf"^[{DIGIT}0-9]+\z"), "number")
        .when(s.rlike(rf"^[{SCRIPT}]+\z"), "khmer")
        .when(s.rlike(f"[{SCRIPT}]"), "mixed")
        .otherwise("non_khmer")
    )


def included(c: Column | str, kind: Column, filter_other: bool = True, punctuation: bool = True, filter_numbers: bool = True, most_digits: int = 1) -> Column:
    """Whether a syllable of that type takes part in frequency training."""
    if not filter_other and not filter_numbers:
        return F.lit(True)
    return (
        F.when(kind == "empty", False)
        .when(kind == "punctuation", punctuation)
        .when(kind == "number", F.length(strip(c)) <= most_digits if filter_numbers else F.lit(True))
        .when(kind == "non_khmer", not filter_other)
        .otherwise(True)
    )


#: One look instead of several for tokens without white space inside: what ``included`` takes by default.
INCLUDED = rf"(?s)^(?![{DIGIT}0-9]{{2,}}\z)(?:.*[{SCRIPT}].*|[{PUNCTUATION}]+|[{DIGIT}0-9])\z"
#: The same for any token: whether ``included`` takes it by its ``syllable_type``, white space at the ends aside.
COUNTED = rf"(?s)^[{_S}]*+(?:(?![{DIGIT}0-9]{{2,}}+[{_S}]*+\z)[^{SCRIPT}]*+[{SCRIPT}].*|[{PUNCTUATION}{_S}]+|[0-9][{_S}]*)\z"
