"""Outlines of Rust sources, approximately: a lexer that knows strings,
comments and brackets, no grammar. Arrow UDFs, one call per batch."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""//[^\n]*|/\*.*?\*/|(?:b|c)?r(#*)".*?"\1|(?:b|c)?"(?:\\.|[^"\\])*"|b?'(?:\\[^']*|[^'\\])'|#!?\[|[A-Za-z_]\w*|[{}()\[\];]|\s+|.""", re.S)
_ITEM = {"fn", "struct", "enum", "trait", "type", "const", "static", "mod", "use", "union"}
STUB = "{ /* ... */ }"


def _tokens(source: str) -> list[str]:
    return [m[0] for m in _TOKEN.finditer(source)]


def _closing(tokens: list[str], at: int) -> int:
    """Index behind the bracket that closes the one at ``at``."""
    depth = 0
    for k in range(at, len(tokens)):
        t = tokens[k]
        depth += t in ("{", "(", "[", "#[", "#![")
        depth -= t in ("}", ")", "]")
        if not depth:
            return k + 1
    return len(tokens)


def _items(source: str):
    """Top-level items: (attributes, head, body, visible, kind). The body has
    its braces; it is empty for items that end with a semicolon."""
    tokens, k = [t for t in _tokens(source) if not t.startswith(("//", "/*"))], 0
    attributes: list[str] = []
    while k < len(tokens):
        t = tokens[k]
        if t.isspace():
            k += 1
        elif t in ("#[", "#!["):
            end = _closing(tokens, k)
            attributes.append("".join(tokens[k:end]))
            k = end
        else:
            head, start = [], k
            while k < len(tokens) and tokens[k] not in ("{", ";"):
                end = _closing(tokens, k) if tokens[k] in ("(", "[") else k + 1
                head += tokens[k:end]
                k = end
            words = [w for w in head if w[:1].isalpha() or w[:1] == "_"]
            kind = next((w for w in words if w in _ITEM or w in ("impl", "extern", "macro_rules")), "")
            body = ""
            if k < len(tokens) and tokens[k] == "{":
                end = _closing(tokens, k)
                body, k = "".join(tokens[k:end]), end
                if kind == "use":
                    head.append(body)
                    body = ""
            if k < len(tokens) and tokens[k] == ";":
                k += 1
            k = max(k, start + 1)
            yield attributes, re.sub(r"\s+", " ", "".join(head)).strip(), body, bool(words) and words[0] == "pub", kind
            attributes = []


def strip_bodies(source: str) -> str:
    """Every top-level function's body as a stub; other items as they are."""
    return "\n".join("".join(a + "\n" for a in attrs) + (f"{head} {STUB}" if kind == "fn" and body else f"{head} {body}" if body else f"{head};") for attrs, head, body, _, kind in _items(source))


def public_api(source: str) -> str:
    """Public items, macros and extern blocks; functions as stubs."""
    out = []
    for _, head, body, visible, kind in _items(source):
        if visible or kind in ("extern", "macro_rules"):
            out.append(f"{head} {STUB}" if kind == "fn" and body else f"{head} {body}" if body else f"{head};")
    return "\n".join(out)


def list_tests(source: str) -> list[str]:
    """Signatures of functions whose attribute path ends in ``test``, at the
    top or in a module for tests."""
    out = []
    for attrs, head, body, _, kind in _items(source):
        if kind == "fn" and any(re.match(r"#\[\s*(?:\w+\s*::\s*)*test\s*[\](]", a) for a in attrs):
            out.append(head)
        elif kind == "mod" and any(re.sub(r"\s", "", a) == "#[cfg(test)]" for a in attrs):
            out += list_tests(body[1:-1])
    return out


def _udf(f, kind: str):
    return F.pandas_udf(lambda s: pd.Series([None if x is None else f(x) for x in s]), kind)


def outline(source: Column) -> Column:
    return _udf(strip_bodies, "string")(source)


def public_outline(source: Column) -> Column:
    return _udf(public_api, "string")(source)


def signatures_of_tests(source: Column) -> Column:
    return _udf(list_tests, "array<string>")(source)
