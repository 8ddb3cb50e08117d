"""Options, profiles and scrub rules from YAML; unknown keys are errors."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from pathlib import Path

from ..operators.budget import STRATEGIES, Budget
from ..operators.scrub import Entropy, Rule, ScrubConfig


class ConfigError(ValueError):
    """A file or option that cannot be used."""


class UnknownProfileError(ConfigError):
    """A profile that no config names."""


#: What presets collect, option values and their aliases.
PRESETS = {
    "fix": ("errors", "diff", "tests"),
    "feature": ("map", "diff", "entry", "tests"),
    "custom": ("map", "diff", "entry", "tests"),
}
FORMATS = ("markdown", "xml", "json", "plain")
TOKENIZERS = ("cl100k", "o200k", "claude", "llama3", "llama2", "chars-div4", "hf")
ALIASES = {"md": "markdown", "text": "plain", "chars-div-4": "chars-div4"}


def parse_choice(value: str, choices) -> str:
    """Trimmed, lower case, ``_`` as ``-``, aliases resolved."""
    v = value.strip().lower().replace("_", "-")
    v = ALIASES.get(v, v)
    if v not in choices:
        raise ConfigError(f"{value!r} is none of {', '.join(choices)}")
    return v


@dataclass(frozen=True)
class PackOptions:
    preset: str = "custom"
    max_tokens: int = 8000
    reserve_tokens: int = 2000
    strategy: str = "priority"
    tokenizer: str = "llama3"
    format: str = "markdown"
    diff: str | None = None
    scrub: bool = True
    expand: str = "off"
    min_confidence: float | None = None
    files_from: tuple[str, ...] = ()
    include_path: tuple[str, ...] = ()
    exclude_path: tuple[str, ...] = ()
    exclude_finding: tuple[str, ...] = ()

    @property
    def budget(self) -> Budget:
        return Budget(self.max_tokens, self.reserve_tokens, self.strategy)


_CHOICES = {"preset": PRESETS, "strategy": STRATEGIES, "tokenizer": TOKENIZERS, "format": FORMATS, "expand": ("on", "off", "auto")}


def _known(data: dict, names, where: str) -> dict:
    bad = sorted(set(data) - set(names))
    if bad:
        raise ConfigError(f"unknown key {bad[0]!r} in {where}")
    return data


def merged(base: PackOptions, override: dict) -> PackOptions:
    """Scalars replace, lists append, None leaves as it is."""
    out = {}
    for name, value in _known(override, [f.name for f in fields(PackOptions)], "options").items():
        if value is None:
            continue
        if name in _CHOICES:
            value = parse_choice(value, _CHOICES[name])
        old = getattr(base, name)
        out[name] = (*old, *value) if isinstance(old, tuple) else value
    if (c := out.get("min_confidence")) is not None and not 0 <= c <= 1:
        raise ConfigError("min_confidence must be between 0 and 1")
    return replace(base, **out)


@dataclass(frozen=True)
class ProjectConfig:
    defaults: dict = field(default_factory=dict)
    profiles: dict = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str) -> ProjectConfig:
        data = _known(_yaml(text) or {}, ("version", "defaults", "profiles"), "config")
        return cls(data.get("defaults") or {}, data.get("profiles") or {})

    @classmethod
    def load(cls, path: str) -> ProjectConfig:
        return cls.parse(Path(path).read_text()) if Path(path).exists() else cls()

    def options(self, profile: str | None = None, **flags) -> PackOptions:
        """Defaults, then the profile, then flags."""
        out = merged(PackOptions(), self.defaults)
        if profile is not None:
            if profile not in self.profiles:
                raise UnknownProfileError(f"no profile {profile!r}; known: {', '.join(sorted(self.profiles)) or 'none'}")
            out = merged(out, self.profiles[profile] or {})
        return merged(out, flags)


def _yaml(text: str):
    try:
        import yaml
    except ImportError:  # JSON is YAML; without the library only that much is read
        import json

        return json.loads(text) if text.strip() else None
    return yaml.safe_load(text)


def scrub_config(text: str) -> ScrubConfig:
    data = _known(_yaml(text) or {}, ("version", "builtins", "patterns", "mode", "entropy", "allowlist", "paths", "report"), "scrub config")
    off = _known(data.get("builtins") or {}, ("disable",), "builtins").get("disable") or ()
    rules = tuple(Rule(**_known(p, [f.name for f in fields(Rule)], "pattern")) for p in data.get("patterns") or ())
    entropy = dict(_known(data.get("entropy") or {}, [f.name for f in fields(Entropy)], "entropy"))
    if "context_keys" in entropy:
        entropy["context_keys"] = tuple(entropy["context_keys"])
    allow = [_known(a, ("exact", "regex"), "allowlist") for a in data.get("allowlist") or ()]
    paths = _known(data.get("paths") or {}, ("redact_whole", "exclude"), "paths")
    return ScrubConfig(
        tuple(off), rules, data.get("mode", "extend"), Entropy(**entropy), tuple(a["exact"] for a in allow if "exact" in a), tuple(a["regex"] for a in allow if "regex" in a), tuple(paths.get("redact_whole") or ()), tuple(paths.get("exclude") or ())
    )
