"""Reports as text, of the few rows that statistics come down to."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame


def value(x: Any) -> str:
    if isinstance(x, bool) or x is None:
        return {True: "yes", False: "no", None: "-"}[x]
    if isinstance(x, int):
        return f"{x:,}"
    return f"{x:,.4f}".rstrip("0").rstrip(".") if isinstance(x, float) else str(x)


def section(title: str, rows: Iterable[Mapping[str, Any]]) -> str:
    """A title and a table of rows with the same keys; one row is listed key by key."""
    rows = [dict(r) for r in rows]
    lines = [title, "-" * len(title)]
    if not rows:
        return "\n".join([*lines, "nothing to report"])
    if len(rows) == 1:
        return "\n".join([*lines, *(f"{k}: {value(v)}" for k, v in rows[0].items())])
    table = [list(rows[0]), *([value(v) for v in r.values()] for r in rows)]
    widths = [max(len(r[k]) for r in table) for k in range(len(table[0]))]
    return "\n".join(lines + ["  ".join(x.ljust(w) for x, w in zip(r, widths)).rstrip() for r in table])


def report(title: str, parts: Mapping[str, DataFrame], most: int = 100) -> str:
    """A report of several tables, each shown by its first ``most`` rows: they are summaries, sorted by whoever made them."""
    lines = [title, "=" * len(title)]
    for name, df in parts.items():
        lines += ["", section(name, (r.asDict() for r in df.limit(most).collect()))]
    return "\n".join(lines) + "\n"
