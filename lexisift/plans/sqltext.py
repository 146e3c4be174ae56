"""Pieces of SQL that checks share."""

from __future__ import annotations

from lexisift.functions.scripts import LATIN, PROJECTED, SCRIPT, SPACE_RE2, segmenter

CORPUS = f"corpus AS (SELECT *, CASE WHEN lang = 'fr' THEN text ELSE translate(lower(text), '{LATIN}', '{PROJECTED}') END AS kt FROM documents)"


def tokens(method: str = "regex_advanced", text: str = "kt") -> str:
    return f"regexp_extract_all({text}, '{segmenter(method, java=False)}')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE_RE2}]+|[{SPACE_RE2}]+\\z', '', 'g')"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def not_blank(x: str) -> str:
    return f"regexp_matches({x}, '[^{SPACE_RE2}]')"


def ratio(x: str) -> str:
    letters = count(x, r"\p{L}")
    return f"coalesce({count(x, f'[{SCRIPT}]')} / nullif({letters}, 0), 0.0)"


SYLLABLES = f"{CORPUS}, lists AS (SELECT doc_id, lang, source, kt, {tokens()} AS s FROM corpus)"
#: One row for each syllable that is not blank.
EACH = f"{SYLLABLES}, each AS (SELECT * FROM (SELECT doc_id, unnest(s) AS syllable FROM lists) WHERE {not_blank('syllable')})"
