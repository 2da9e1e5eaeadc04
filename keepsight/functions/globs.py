"""Glob patterns compiled once, on the driver, to one anchored regex."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKENS = re.compile(r"\*\*/|\*\*|\*|\?|\[[!^]?[^\]]+\]|\{|\}|,|\\.|.", re.DOTALL)


def glob_to_regex(pattern: str) -> str:
    """``**/`` spans any number of directories, none included; ``*`` and ``?`` stay in one.

    ``{a,b}`` is an alternation and may nest; ``[a-z]``/``[!a-z]`` are classes.
    """
    out, depth = [], 0
    for token in _TOKENS.findall(pattern):
        if token == "**/":
            out.append("(?:[^/]*/)*")
        elif token == "**":
            out.append(".*")
        elif token == "*":
            out.append("[^/]*")
        elif token == "?":
            out.append("[^/]")
        elif token == "{":
            depth += 1
            out.append("(?:")
        elif token == "}" and depth:
            depth -= 1
            out.append(")")
        elif token == "," and depth:
            out.append("|")
        elif len(token) > 1 and token[0] == "[":
            body = token[1:-1]
            negated = body[0] in "!^"
            body = (body[1:] if negated else body).replace("\\", "\\\\").replace("[", "\\[")
            body = body.replace("&&", "&\\&")
            out.append(f"(?!/)[{'^' if negated else ''}{body}]")
        elif len(token) == 2 and token[0] == "\\":
            out.append(re.escape(token[1]))
        else:
            out.append(re.escape(token))
    if depth:
        raise ValueError(f"unbalanced brace in glob: {pattern!r}")
    return "".join(out)


def literal_head(pattern: str) -> str | None:
    """The folder that every path matching ``pattern`` lies below; None if it names none."""
    literal = re.match(r"[^*?\[\]{}\\,]*", pattern).group()
    return literal.rpartition("/")[0] if "/" in literal else None


def any_regex(patterns: Sequence[str]) -> str:
    return r"(?s)\A(?:" + "|".join(glob_to_regex(p) for p in patterns) + r")\z"


def matches_any(path: Column, patterns: Sequence[str]) -> Column:
    """True where ``path`` matches at least one glob."""
    return path.rlike(any_regex(patterns)) if patterns else F.lit(False)
