"""Path globs as regular expressions, so that matching is a pushed-down RLIKE."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


class GlobError(ValueError):
    """A pattern that is no glob."""


def is_glob(pattern: str) -> bool:
    return any(c in pattern for c in "*?[{")


def glob_regex(pattern: str) -> str:
    """An anchored regular expression that Java and RE2 both read. ``*`` and
    ``?`` cross ``/``; ``**/`` spans whole directories; ``[!x]`` negates;
    ``{a,b}`` alternates; a backslash escapes."""
    out, i, depth = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
            continue
        if c == "*":
            while pattern[i : i + 1] == "*":
                i += 1
            out.append(".*")
            continue
        if c == "?":
            out.append(".")
        elif c == "[":
            end = pattern.find("]", i + 2 + (pattern[i + 1 : i + 2] in ("!", "^")))
            if end < 0:
                raise GlobError(f"unclosed class in {pattern!r}")
            body = pattern[i + 1 : end]
            negate = body[:1] in ("!", "^")
            body = body[negate:].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append(f"[{'^' * negate}{body}]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        else:
            if c == "\\" and i + 1 < len(pattern):
                i += 1
                c = pattern[i]
            out.append("\\" + c if c in "\\.+()|^$[]{}*?" else c)
        i += 1
    if depth:
        raise GlobError(f"unclosed brace in {pattern!r}")
    return "(?s)^" + "".join(out) + "$"


def matches_any(path: Column, patterns: list[str]) -> Column:
    """Whether a path matches one of the globs; false for none."""
    return reduce(lambda a, b: a | b, (path.rlike(glob_regex(p)) for p in patterns), F.lit(False))


def allowed(path: Column, include: list[str] = (), exclude: list[str] = ()) -> Column:
    """Include filter (none: all), then exclude, which wins."""
    ok = matches_any(path, list(include)) if include else F.lit(True)
    return ok & ~matches_any(path, list(exclude))
