"""Character classes of the script and the patterns built from them, for Spark (Java) and for SQL checks (RE2).

Classes are written as ``\\x{..}`` ranges, which both dialects read. Java loops that could go deep are possessive.
"""

from __future__ import annotations

# Ranges of code points of the segmenter's classes.
CONSONANT = r"\x{1780}-\x{17A2}"
INDEPENDENT = r"\x{17A5}-\x{17B3}"
DEPENDENT = r"\x{17B6}-\x{17C8}"
DIACRITIC = r"\x{17C9}-\x{17D1}\x{17DD}"
COENG = r"\x{17D2}"
SYMBOL = r"\x{17D4}-\x{17DC}"
DIGIT = r"\x{17E0}-\x{17E9}"
SCRIPT = r"\x{1780}-\x{17FF}"
# Ranges of the rule validator, which differ on purpose.
RULE_CONSONANT = r"\x{1780}-\x{17A2}"
RULE_VOWEL = r"\x{17A5}-\x{17B2}\x{17B6}-\x{17D2}"
RULE_DEPENDENT = r"\x{17B6}-\x{17D2}"
RULE_MARK = r"\x{17C6}-\x{17D2}"

MARKS = r"\x{17B6}-\x{17D1}"
MARKS_MORE = MARKS + r"\x{17DD}"
OTHER = rf"[{DIGIT}]+|[{SCRIPT}]"

# Python's white space in either dialect.
SPACE = r"\s\x1c-\x1f\x85\p{Z}"
SPACE_RE2 = r"\s\x0b\x1c-\x1f\x85\p{Z}"


def segmenter(method: str, java: bool = True) -> str:
    """The pattern whose matches, in order, are a method's syllables."""
    c, v, o = f"[{CONSONANT}]", f"[{MARKS_MORE}]", COENG
    w, own, once = f"[{MARKS}]", "+" if java else "", "(?U)" if java else ""
    tail = rf"{v}+|[{DIGIT}]+|[{SCRIPT}]|[^{SCRIPT}\s]+"
    if method == "no_regex_fast":
        return rf"{once}\s+|[{INDEPENDENT}](?:{o}(?:{c}{v}*)?|{v}*)|{c}(?:{o}{c})*{own}{o}?{v}*|{tail}"
    if method == "no_regex":
        return rf"{once}\s+|[{INDEPENDENT}](?:{o}(?:{c}{v}*)?|{v}*)|{c}(?:{o}{c}?)*{own}{v}*|{tail}"
    if method in ("regex_basic", "regex_advanced"):
        return rf"{once}\s+|[{INDEPENDENT}](?:{o}{c}{w}*)?|{c}(?:{o}{c})*{own}{w}*{own}(?:{o}{w}+{own})*{own}|{v}+|{o}|[{DIGIT}]+|[{SYMBOL}]|[^{SCRIPT}\s]+"
    raise ValueError(f"no segmentation method {method}")


METHODS = ("regex_basic", "regex_advanced", "no_regex", "no_regex_fast")

#: Fixed value: letters a to z and the script letters they become in the projected corpus.
LATIN = "abcdefghijklmnopqrstuvwxyz"
PROJECTED = "".join(map(chr, [0x1780, 0x17B6, 0x1782, 0x178F, 0x17C1, 0x1795, 0x1784, 0x17A0, 0x17B7, 0x1787, 0x1783, 0x179B, 0x1798, 0x1793, 0x17C4, 0x1796, 0x1785, 0x179A, 0x179F, 0x1791, 0x17BB, 0x179C, 0x17D2, 0x17A2, 0x1799, 0x17A7]))
