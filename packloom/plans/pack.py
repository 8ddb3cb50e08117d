"""Assembling packs: scrub, count, budget, manifest, render - for every
pack_id of a table of candidate sections at once."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.globs import matches_any
from ..functions.tokens import estimate, tokenizer_label
from ..operators.budget import allocate, outcome
from ..operators.findings import check_min_confidence
from ..operators.relations import provenance, provenance_counts
from ..operators.scrub import Scrubber
from . import render
from .config import PRESETS, PackOptions

SCHEMA = "packloom/v1"


@dataclass(frozen=True)
class PackResult:
    """``files``: (pack_id, path, sources, status, reason) of sections that have
    a path."""

    packs: DataFrame
    sections: DataFrame
    decisions: DataFrame
    redactions: DataFrame
    files: DataFrame


class PackBuilder:
    """Fluent options; ``build`` takes rows (pack_id, ord, priority, name,
    content) and, if they are there, path, collector and confidence. Each
    setter returns a new builder."""

    def __init__(self, options: PackOptions | None = None, scrubber: Scrubber | None = None, project: str = "unknown"):
        self.options, self.scrubber, self.project = options or PackOptions(), scrubber, project

    def with_options(self, **changes) -> PackBuilder:
        return PackBuilder(replace(self.options, **changes), self.scrubber, self.project)

    def preset(self, name: str) -> PackBuilder:
        return self.with_options(preset=name)

    def budget(self, max_tokens: int, reserve: int = 2000, strategy: str = "priority") -> PackBuilder:
        return self.with_options(max_tokens=max_tokens, reserve_tokens=reserve, strategy=strategy)

    def tokenizer(self, name: str) -> PackBuilder:
        return self.with_options(tokenizer=name)

    def scrub(self, scrubber: Scrubber | None) -> PackBuilder:
        return PackBuilder(replace(self.options, scrub=scrubber is not None), scrubber, self.project)

    def exclude(self, *globs: str) -> PackBuilder:
        return self.with_options(exclude_path=(*self.options.exclude_path, *globs))

    def include(self, *globs: str) -> PackBuilder:
        return self.with_options(include_path=(*self.options.include_path, *globs))

    def min_confidence(self, value: float) -> PackBuilder:
        return self.with_options(min_confidence=check_min_confidence(value))

    def wants(self, collector: str) -> bool:
        """Whether the preset collects it: others never enter the plan."""
        return collector in PRESETS[self.options.preset]

    def _manifest(self, df: DataFrame, used: str, budget: str, reserve: str, changed) -> DataFrame:
        o = self.options
        lits = lambda xs: F.array(*(F.lit(x) for x in xs)).cast("array<string>")
        return df.withColumn(
            "manifest",
            render.manifest_markdown(
                {
                    "preset": F.lit(o.preset), "diff_source": F.lit(o.diff or "working tree"), "collectors": lits(PRESETS[o.preset]), "strategy": F.lit(o.strategy),
                    "tokens_used": F.col(used), "tokens_budget": F.col(budget), "manifest_tokens": F.col(reserve), "changed": changed, "redactions": F.col("redactions"),
                    "scrub_enabled": F.lit(o.scrub), "include": lits(o.include_path), "exclude": lits(o.exclude_path), "included": F.col("included"), "suppressed": F.col("suppressed"),
                }
            ),
        )

    def _scrubbed_manifest(self, df: DataFrame, scrubber: Scrubber, *args) -> DataFrame:
        """The manifest, scrubbed; what is redacted in it counts as well."""
        first = scrubber.scrub(self._manifest(df, *args), "manifest", "in_manifest")
        first = first.withColumn("redactions", F.col("redactions") + F.size("in_manifest"))
        return scrubber.scrub(self._manifest(first, *args), "manifest", None)

    def select(self, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
        """What of the candidates the options let in, and (pack_id, path,
        sources, status, reason) of their files.

        A section goes if its path matches an exclude glob; if its collector is
        none of the preset's, unless its path matches an include glob; or if its
        confidence is known and below ``min_confidence``. Null or absent paths,
        collectors and confidences let a section in."""
        o = self.options
        absent = {"path": "string", "collector": "string", "confidence": "double"}
        rows = candidates.withColumns({c: F.lit(None).cast(t) for c, t in absent.items() if c not in candidates.columns})
        excluded = F.coalesce(matches_any(F.col("path"), list(o.exclude_path)), F.lit(False))
        forced = F.coalesce(matches_any(F.col("path"), list(o.include_path)), F.lit(False))
        unwanted = ~forced & ~F.coalesce(F.col("collector").isin(list(PRESETS[o.preset])) | (F.col("collector") == "include"), F.lit(True))
        doubtful = F.lit(False) if o.min_confidence is None else F.coalesce(F.col("confidence") < o.min_confidence, F.lit(False))
        reason = F.when(excluded, F.lit("--exclude-path")).when(unwanted, F.lit("preset")).when(doubtful, F.lit("--min-confidence"))
        rows = rows.withColumn("reason", reason)
        # What the preset doesn't collect was never seen; the rest has a status.
        seen = rows.where(~unwanted | excluded).where("path is not null")
        events = seen.select("pack_id", F.struct((F.col("priority") != 0).alias("c"), "priority", "ord").alias("seq"), "path", F.coalesce("collector", "name").alias("source"), F.col("reason").isNull().alias("allowed"), "reason")
        return rows.where("reason is null").drop("reason", *absent), provenance(events, ["pack_id"])

    def build(self, candidates: DataFrame) -> PackResult:
        o = self.options
        scrubber = (self.scrubber or Scrubber()) if o.scrub else Scrubber.empty()
        allowed, files = self.select(candidates)
        rows = scrubber.scrub(scrubber.scrub(allowed.select("pack_id", "ord", "priority", "name", "content"), "name", "r1"), "content", "r2")
        rows = rows.withColumn("report", F.concat("r1", "r2")).drop("r1", "r2")
        rows = rows.withColumn("token_estimate", estimate(F.col("content"), o.tokenizer))
        # The manifest's own tokens come off first, estimated before decisions exist.
        # A pack stays, if only as a manifest, when all its sections go.
        packs = candidates.select("pack_id").distinct().join(rows.groupBy("pack_id").agg(F.sum(F.size("report")).alias("redactions")), "pack_id", "left")
        packs = packs.join(provenance_counts(files, ["pack_id"]), "pack_id", "left").fillna(0, ["redactions", "included", "suppressed"])
        packs = packs.withColumns({"zero": F.lit(0).cast("bigint"), "limit": F.lit(o.budget.effective).cast("bigint")})
        packs = self._manifest(packs, "zero", "limit", "zero", F.lit(0))
        packs = packs.withColumn("manifest_tokens", estimate(F.col("manifest"), o.tokenizer)).drop("manifest", "zero")
        sections = rows.join(packs.select("pack_id", "manifest_tokens", "limit"), "pack_id")
        decisions = allocate(sections, o.budget, F.greatest(F.col("limit") - F.col("manifest_tokens"), F.lit(0)), o.tokenizer)
        totals = outcome(decisions)
        packs = packs.join(totals, "pack_id", "left").fillna(0, ["tokens_used", "kept", "truncated", "dropped"])
        packs = packs.withColumn("tokens_used", F.col("tokens_used") + F.col("manifest_tokens"))
        packs = self._scrubbed_manifest(packs, scrubber, "tokens_used", "limit", "manifest_tokens", F.col("truncated") + F.col("dropped"))
        files = scrubber.scrub(scrubber.scrub(files, "path", None), "reason", None)
        kept = decisions.where("outcome != 'dropped'").withColumn("token_estimate", F.col("final_tokens"))
        return PackResult(packs, kept, decisions, rows.select("pack_id", "ord", F.explode("report").alias("r")).select("pack_id", "ord", "r.*"), files)

    def render(self, result: PackResult, format: str | None = None) -> DataFrame:
        """(pack_id, text)."""
        form = format or self.options.format
        order = F.struct((F.col("priority") != 0).alias("c"), "priority", "ord")
        ordered = lambda col: F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), col.alias("x")))), lambda s: s["x"])
        body = result.sections.groupBy("pack_id").agg(
            ordered(F.col("content")).alias("contents"), F.array_join(ordered(render.sections_markdown()), "").alias("md"), F.array_join(ordered(render.sections_xml()), "").alias("xml"),
            ordered(F.struct("name", "content", "token_estimate")).alias("sections"),
        )
        lost = result.decisions.where("outcome = 'dropped'").groupBy("pack_id").agg(ordered(F.col("name")).alias("lost"))
        none = F.array().cast("array<string>")
        df = result.packs.join(body, "pack_id", "left").join(lost, "pack_id", "left").withColumn("lost", F.coalesce("lost", none))
        md, xml, contents = F.coalesce("md", F.lit("")), F.coalesce("xml", F.lit("")), F.coalesce("contents", none)
        schema, project, label = F.lit(SCHEMA), F.lit(self.project), F.lit(tokenizer_label(self.options.tokenizer))
        if form == "markdown":
            text = render.markdown(schema, project, F.col("tokens_used"), F.col("limit"), label, F.col("lost"), F.col("manifest"), md)
        elif form == "xml":
            text = render.xml(schema, project, F.col("tokens_used"), F.col("limit"), label, F.col("manifest"), xml)
        elif form == "plain":
            text = render.plain(F.col("manifest"), contents)
        else:
            text = render.json(F.struct(schema.alias("schema"), project.alias("project"), "sections", "tokens_used", F.col("limit").alias("tokens_budget"), label.alias("tokenizer"), F.col("lost").alias("dropped"), "manifest", "redactions"))
        return df.select("pack_id", text.alias("text"))
