"""Renderers: ordered aggregation of rows into texts. Nothing is escaped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import descriptor, language_hint, language_of
from ..sources.diagnostics import primary_span
from .long_texts import joined

TICK = "`"


def in_order(order: Column, text: Column) -> Column:
    """Aggregate: texts concatenated in order."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t"))))
    return F.array_join(F.transform(rows, lambda x: x["t"]), "")


def _s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def ticked(items: Column) -> Column:
    return F.concat(F.lit(TICK), F.array_join(items, "`, `"), F.lit(TICK))


def fenced(lang: Column, content: Column) -> Column:
    return F.concat(F.lit("```"), lang, F.lit("\n"), F.rtrim(content, F.lit(" \n\r\t")), F.lit("\n```\n"))


def manifest_markdown(m: dict[str, Column]) -> Column:
    """From columns preset, diff_source, collectors, strategy, tokens_used,
    tokens_budget, manifest_tokens, changed, redactions, scrub_enabled,
    include, exclude, included, suppressed."""
    line = lambda cond, *parts: F.when(cond, F.concat(*parts)).otherwise("")
    return F.concat(
        F.lit("- Preset: `"), m["preset"], F.lit("`\n- Diff source: `"), m["diff_source"], F.lit("`\n"),
        line(F.size(m["collectors"]) > 0, F.lit("- Collectors: "), ticked(m["collectors"]), F.lit("\n")),
        F.lit("- Budget: `"), m["strategy"], F.lit("` strategy, "), _s(m["tokens_used"]), F.lit("/"), _s(m["tokens_budget"]), F.lit(" tokens"),
        line(m["manifest_tokens"] > 0, F.lit(" (manifest: "), _s(m["manifest_tokens"]), F.lit(")")),
        line(m["changed"] > 0, F.lit(", "), _s(m["changed"]), F.lit(" section decision(s)")),
        F.lit("\n- Scrub: "), _s(m["redactions"]), F.lit(" redaction(s)"), F.when(m["scrub_enabled"], "").otherwise(" (disabled)"), F.lit("\n"),
        line(F.size(m["include"]) > 0, F.lit("- Include filters: "), ticked(m["include"]), F.lit("\n")),
        line(F.size(m["exclude"]) > 0, F.lit("- Exclude filters: "), ticked(m["exclude"]), F.lit("\n")),
        line((m["included"] > 0) | (m["suppressed"] > 0), F.lit("- Files: "), _s(m["included"]), F.lit(" included, "), _s(m["suppressed"]), F.lit(" suppressed\n")),
    )


def indented(text: Column, indent: str = "    ") -> Column:
    """Every line of a text that ends with a line feed."""
    return F.regexp_replace(text, "(?m)^(?=.)", indent)


def sections_markdown() -> Column:
    return F.concat(F.lit("## "), F.col("name"), F.lit("\n\n"), F.col("content"), F.lit("\n\n"))


def sections_xml() -> Column:
    return F.concat(F.lit('  <section name="'), F.col("name"), F.lit('" tokens="'), _s("token_estimate"), F.lit('">\n'), F.col("content"), F.lit("\n  </section>\n"))


def markdown(schema, project, used, budget, tokenizer, dropped: Column, manifest: Column, sections: Column) -> Column:
    lost = F.when(F.size(dropped) > 0, F.concat(F.lit(" | dropped: "), F.array_join(dropped, ", "))).otherwise("")
    return F.concat(
        F.lit("# PROJECT CONTEXT PACK: "), project, F.lit("\n<!-- schema: "), schema, F.lit(" | tokens: "), _s(used), F.lit("/"), _s(budget), F.lit(" | tokenizer: "), tokenizer, lost, F.lit(" -->\n\n"),
        F.lit("## 🧾 Context Manifest\n\n"), manifest, F.lit("\n\n"), sections,
    )


def xml(schema, project, used, budget, tokenizer, manifest: Column, sections: Column) -> Column:
    return F.concat(
        F.lit('<pack schema="'), schema, F.lit('" project="'), project, F.lit('" tokens="'), _s(used), F.lit("/"), _s(budget), F.lit('" tokenizer="'), tokenizer, F.lit('">\n'),
        F.lit("  <manifest>\n"), indented(manifest), F.lit("  </manifest>\n"), sections, F.lit("</pack>\n"),
    )


def plain(manifest: Column, contents: Column) -> Column:
    """``contents``: array of section contents in order."""
    return F.array_join(F.concat(F.array(F.concat(F.lit("Context Manifest\n"), manifest)), contents), "\n\n")


def json(pack: Column) -> Column:
    return F.to_json(pack, {"pretty": "true", "ignoreNullFields": "false"})


def diff(files: DataFrame, keys: list[str]) -> DataFrame:
    """Files (path, old_path, status, hunks, has_error, redacted) as one text
    per key: erroneous files first, then by path."""
    hunk = lambda h: F.concat(F.lit("```diff\n@@ -"), _s(h["old_start"]), F.lit(","), _s(h["old_lines"]), F.lit(" +"), _s(h["new_start"]), F.lit(","), _s(h["new_lines"]), F.lit(" @@\n"), h["body"], F.lit("```\n"))
    hunks = F.coalesce("hunks", F.slice("hunks", F.lit(1), F.lit(0)))
    elided = F.concat(F.lit("[REDACTED FILE: "), F.col("path"), F.lit(" — "), _s(F.coalesce(F.size("hunks"), F.lit(0))), F.lit(" hunk(s) elided by scrub.yaml path rules]\n"))
    text = F.concat(
        F.lit("### `"), F.col("path"), F.lit("` — "), F.col("status"), F.when(F.col("has_error"), " ⚠").otherwise(""), F.when(F.col("redacted"), " 🔒").otherwise(""), F.lit("\n"),
        F.coalesce(F.concat(F.lit("- Renamed from `"), F.col("old_path"), F.lit("`\n")), F.lit("")),
        F.when(F.col("redacted"), elided).otherwise(F.coalesce(F.array_join(F.transform(hunks, hunk), ""), F.lit(""))), F.lit("\n"),
    )
    n = F.count("*")
    bad, hidden = F.count_if("has_error"), F.count_if("redacted")
    head = F.concat(
        _s(n), F.lit(" file(s) changed"), F.when(bad > 0, F.concat(F.lit("; "), _s(bad), F.lit(" touched by compiler errors (shown first)"))).otherwise(""),
        F.when(hidden > 0, F.concat(F.lit("; "), _s(hidden), F.lit(" redacted by path rules"))).otherwise(""), F.lit(".\n\n"),
    )
    order = F.struct((~F.col("has_error")).alias("e"), F.col("path").alias("p"))
    return files.groupBy(*keys).agg(F.concat(head, in_order(order, text)).alias("text"))


def diagnostics(rows: DataFrame, keys: list[str], success: Column) -> DataFrame:
    span = primary_span(F.col("spans"))
    names = F.initcap("level")
    text = F.concat(
        F.lit("- **"), names, F.lit("** "), F.coalesce("code", F.lit("")), F.lit(": "), F.col("message"), F.lit("\n"),
        F.coalesce(F.concat(F.lit("  at `"), span["file"], F.lit(":"), _s(span["line_start"]), F.lit(":"), _s(span["col_start"]), F.lit("`\n")), F.lit("")),
    )
    head = F.concat(F.lit("Build "), F.when(success, "succeeded").otherwise("failed"), F.lit("; "), _s(F.count("*")), F.lit(" diagnostic(s), "), _s(F.count_if(F.col("level") == "error")), F.lit(" error(s).\n\n"))
    return rows.groupBy(*keys).agg(F.concat(head, in_order(F.col("ord"), text)).alias("text"))


def workspace(root: Column, members: Column, dependencies: Column, most: int = 12) -> Column:
    """Sorted member names and external dependencies, the first ``most`` of them."""
    more = F.when(F.size(dependencies) > most, F.concat(F.lit(" (+"), _s(F.size(dependencies) - most), F.lit(" more)"))).otherwise("")
    return F.concat(
        F.coalesce(F.concat(F.lit("- Root package: `"), root, F.lit("`\n")), F.lit("")),
        F.when(F.size(members) > 0, F.concat(F.lit("- Workspace members ("), _s(F.size(members)), F.lit("): "), F.array_join(members, ", "), F.lit("\n"))).otherwise(""),
        F.when(F.size(dependencies) > 0, F.concat(F.lit("- Key dependencies: "), F.array_join(F.slice(dependencies, 1, most), ", "), more, F.lit("\n"))).otherwise(""),
    )


def entries(rows: DataFrame, keys: list[str]) -> DataFrame:
    body = F.when(F.col("rendered").endswith("\n"), F.col("rendered")).otherwise(F.concat("rendered", F.lit("\n")))
    text = F.concat(F.lit("### `"), F.col("path"), F.lit("` — "), F.col("crate"), F.lit(" / "), F.col("kind"), F.lit(" ("), _s("lines"), F.lit(" lines)\n```rust\n"), body, F.lit("```\n\n"))
    return joined(rows, keys, F.col("path"), text, lambda n: f"{n} entry file(s).\n\n")


def tests(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (path, crate, kind, functions array<string>, matched_stems)."""
    why = F.when(F.size("matched_stems") > 0, F.concat(F.lit(" — matched: "), ticked(F.col("matched_stems")))).otherwise("")
    items = F.array_join(F.transform("functions", lambda f: F.concat(F.lit("- `"), F.trim(f), F.lit("`\n"))), "")
    text = F.concat(F.lit("### `"), F.col("path"), F.lit("` — "), F.col("crate"), F.lit(" / "), F.col("kind"), F.lit(" ("), _s(F.size("functions")), F.lit(" tests)"), why, F.lit("\n"), items, F.lit("\n"))
    return rows.groupBy(*keys).agg(F.concat(_s(F.count("*")), F.lit(" related test file(s).\n\n"), in_order(F.col("path"), text)).alias("text"))


def scoped_files(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (ord, path, content or null) as the files-from section."""
    text = F.when(F.col("content").isNotNull(), F.concat(F.lit("### `"), F.col("path"), F.lit("`\n"), fenced(language_of(F.col("path")), F.col("content")), F.lit("\n"))).otherwise("")
    gone = F.count_if(F.col("content").isNull())
    head = F.concat(_s(F.count("content")), F.lit(" file(s) included via --files-from"), F.when(gone > 0, F.concat(F.lit(" ("), _s(gone), F.lit(" listed path(s) skipped: missing, not a regular file, or unreadable)"))).otherwise(""), F.lit(".\n\n"))
    return rows.groupBy(*keys).agg(F.concat(head, in_order(F.col("ord"), text)).alias("text"))


def scoped_findings(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (rank, primary_path, labels, lang, content or null)."""
    text = F.when(F.col("content").isNotNull(), F.concat(F.lit("### `"), F.col("primary_path"), F.lit("` — "), F.col("labels"), F.lit("\n"), fenced(F.col("lang"), F.col("content")), F.lit("\n"))).otherwise("")
    gone = F.count_if(F.col("content").isNull())
    head = F.concat(_s(F.count("content")), F.lit(" file(s) included via --impact-scope (sorted by confidence desc)"), F.when(gone > 0, F.concat(F.lit("; "), _s(gone), F.lit(" listed path(s) skipped (missing or unreadable)"))).otherwise(""), F.lit(".\n\n"))
    return rows.groupBy(*keys).agg(F.concat(head, in_order(F.col("rank"), text)).alias("text"))


def per_finding(rows: DataFrame) -> DataFrame:
    """One section per finding with content: adds name and text."""
    d = descriptor(F.col("kind"), F.col("severity"), F.col("tier"), F.col("confidence"))
    name = F.concat(F.lit("📂 Impact: "), F.coalesce("id", F.concat(F.lit("finding-"), _s("rank"))), F.when(d == "", "").otherwise(F.concat(F.lit(" ("), d, F.lit(")"))))
    text = F.concat(
        F.coalesce(F.concat(F.lit("**Evidence:** "), F.col("evidence"), F.lit("\n\n")), F.lit("")),
        F.coalesce(F.concat(F.lit("**Suggested action:** `"), F.col("suggested_action"), F.lit("`\n\n")), F.lit("")),
        F.lit("### `"), F.col("primary_path"), F.lit("`\n"), fenced(language_hint(F.col("kind"), F.col("primary_path")), F.col("content")),
    )
    return rows.where("content is not null").withColumns({"section": name, "text": text})


def scope_filters(include: Column, exclude: Column, unmatched: Column, counts: dict[str, Column]) -> Column:
    """Null without patterns. ``counts``: diff, scoped, impact, include."""
    total = sum(counts.values(), F.lit(0))
    parts = F.filter(F.array(*(F.when(c > 0, F.concat(F.lit(f"{k}:"), _s(c))) for k, c in counts.items())), lambda x: x.isNotNull())
    out = F.concat(
        F.when(F.size(include) > 0, F.concat(F.lit("- Include patterns: "), ticked(include), F.lit("\n"))).otherwise(""),
        F.when(F.size(exclude) > 0, F.concat(F.lit("- Exclude patterns: "), ticked(exclude), F.lit("\n"))).otherwise(""),
        F.when(total > 0, F.concat(F.lit("- Excluded by `--exclude-path`: "), _s(total), F.lit(" candidate(s) ("), F.array_join(parts, ", "), F.lit(")\n"))).otherwise(""),
        F.when(F.size(unmatched) > 0, F.concat(F.lit("- Include patterns with no included files: "), ticked(unmatched), F.lit("\n"))).otherwise(""),
    )
    return F.when((F.size(include) > 0) | (F.size(exclude) > 0), out)
