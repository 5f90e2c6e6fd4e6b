"""Path globs as regular expressions: `**` spans folders, `*` and `?` stay within one, everything is anchored."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPECIAL = re.compile(r"([\\.^$|()\[\]{}+*?])")


def segment_regex(segment: str) -> str:
    return "".join({"*": "[^/]*", "?": "[^/]"}.get(c) or _SPECIAL.sub(r"\\\1", c) for c in segment)


def glob_regex(pattern: str) -> str:
    """The anchored expression of a glob, which Java, Python and RE2 read alike."""
    segments = pattern.split("/")
    if segments == ["**"]:
        return r"^(?s:.*)$"
    body = ""
    for k, s in enumerate(segments):
        last = k == len(segments) - 1
        if s == "**":
            # A leading or middle one stands for any number of folders, a last one for anything below.
            body = re.sub("/$", "", body) + "(?:/.*)?" if last else body + "(?:[^/]+/)*"
        else:
            body += segment_regex(s) + ("" if last else "/")
    return f"^{body}$"


def matches_any(path: str | Column, patterns: Sequence[str] | None) -> Column:
    """Whether a path matches one of the globs; no glob matches nothing."""
    column = F.col(path) if isinstance(path, str) else path
    out = F.lit(False)
    for p in patterns or ():
        out = out | column.rlike(glob_regex(p))
    return out
