"""Small scalar functions of paths, statuses, findings and rendered texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language by extension, status by code, levels, dependency kinds.
LANGUAGES = {
    "rs": "rust", "toml": "toml", "yaml": "yaml", "yml": "yaml", "json": "json", "md": "markdown",
    "sh": "bash", "bash": "bash", "py": "python", "ts": "typescript", "js": "javascript",
}
STATUSES = {"A": "added", "M": "modified", "D": "deleted", "R": "renamed", "C": "copied", "T": "typechange"}
LEVELS = {"error": "error", "warning": "warning", "note": "note", "help": "help", "error: internal compiler error": "ice"}
DEPENDENCY_KINDS = {"dev": "dev", "build": "build"}
_STEM_SKIP = ["mod", "lib", "main", "Cargo", "README"]


def lookup(key: Column, table: dict[str, str], default: str) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)/*$", 1)


def extension(path: Column) -> Column:
    """Of the file name; dotfiles have none."""
    return F.regexp_extract(file_name(path), "^.+\\.([^.]*)$", 1)


def language_of(path: Column) -> Column:
    return lookup(extension(path), LANGUAGES, "")


def language_hint(kind: Column, path: Column) -> Column:
    return F.when(kind.isin("doc_drift_link", "doc_drift_keyword"), F.lit("markdown")).otherwise(language_of(path))


def status_of(code: Column) -> Column:
    return lookup(F.substring(code, 1, 1), STATUSES, "unknown")


def level_of(level: Column) -> Column:
    return lookup(level, LEVELS, "other")


def dependency_kind(kind: Column) -> Column:
    return lookup(F.coalesce(kind, F.lit("")), DEPENDENCY_KINDS, "normal")


def project_name(root: Column) -> Column:
    name = file_name(root)
    return F.when(root.isNull() | (name == ""), F.lit("unknown")).otherwise(name)


def path_key(path: Column, root: str) -> Column:
    """Relative to ``root``, with forward slashes."""
    p = F.translate(path, "\\", "/")
    prefix = root.replace("\\", "/").rstrip("/") + "/"
    return F.when(p.startswith(prefix), F.substr(p, F.lit(len(prefix) + 1))).otherwise(p)


def path_order(path: Column) -> Column:
    """Sorts as paths do, component by component."""
    return F.split(path, "/")


def suffix_match(a: Column, b: Column) -> Column:
    return a.endswith(b) | b.endswith(a)


def stem(path: Column) -> Column:
    """Identifier-like stem of a changed file, null if it says nothing."""
    s = F.regexp_extract(file_name(path), "^(.+?)(?:\\.[^.]*)?$", 1)
    return F.when((F.octet_length(s) >= 3) & s.rlike("^[\\p{L}_][\\p{L}\\p{N}_]*$") & ~s.isin(_STEM_SKIP), s)


def contains_word(text: Column, word: str) -> Column:
    """Whole-word containment; ASCII identifier characters bound a word."""
    return text.rlike("(?<![A-Za-z0-9_])\\Q" + word + "\\E(?![A-Za-z0-9_])")


def line_count(text: Column) -> Column:
    """Lines; a final line feed ends the last line and starts none."""
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, "\n", -1)) - F.when(text.endswith("\n"), 1).otherwise(0)).cast("bigint")


def descriptor(kind: Column, severity: Column, tier: Column, confidence: Column) -> Column:
    grade = F.concat_ws("/", severity, tier)
    return F.concat_ws(", ", kind, F.when(grade != "", grade), F.when(confidence.isNotNull(), F.format_string("conf=%.2f", confidence)))


def hash4(text: Column) -> Column:
    """Four hex digits that identify a secret without revealing it."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 4)


def cache_key(*parts: Column) -> Column:
    """Twelve bytes of hash over the parts, in hex."""
    return F.substring(F.sha2(F.concat_ws("\n", *parts), 256), 1, 24)


def shannon(text: Column) -> Column:
    """Entropy of the bytes, bits per byte; 0 for the empty text."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit(".."), F.lit(0))
    return F.transform(
        F.array(pairs),
        lambda a: F.aggregate(
            F.transform(F.array_distinct(a), lambda b: F.size(F.filter(a, lambda x: x == b)).cast("double") / F.size(a)),
            F.lit(0.0),
            lambda acc, p: acc - p * F.log2(p),
        ),
    )[0]


def shannon_text(text: Column) -> Column:
    """``shannon`` of whole texts: one fold over the runs of the sorted bytes."""
    pairs = F.array_sort(F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit(".."), F.lit(0)))
    weigh = lambda n: n * F.log2(F.greatest(n, F.lit(1.0)))
    start = F.struct(F.lit("").alias("b"), F.lit(0.0).alias("n"), F.lit(0.0).alias("total"))
    step = lambda s, b: F.when(s["b"] == b, F.struct(b.alias("b"), (s["n"] + 1).alias("n"), s["total"].alias("total"))).otherwise(F.struct(b.alias("b"), F.lit(1.0).alias("n"), (s["total"] + weigh(s["n"])).alias("total")))
    size = F.octet_length(text).cast("double")
    bits = F.log2(size) - F.aggregate(pairs, start, step, lambda s: s["total"] + weigh(s["n"])) / size
    return F.when(size == 0, F.lit(0.0)).when(size > 0, F.greatest(bits, F.lit(0.0)))


def free_name(df, name: str) -> str:
    """``name``, lengthened until no column has it, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
