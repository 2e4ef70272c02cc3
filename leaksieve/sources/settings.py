"""Settings and rule files. They are small, and read on the driver."""

from __future__ import annotations

import json
import tomllib
import warnings
from dataclasses import dataclass, field
from pathlib import Path

from ..functions.text import MIN_TOKEN_BYTES, THRESHOLD, wildcard_pattern
from ..operators.bindings import SENSITIVE_NAMES
from ..operators.rules import RULES, Rule, with_custom
from .lines import EXCLUDE_DIRS, EXCLUDE_FILES


@dataclass(frozen=True)
class Settings:
    """What a scan can be told. Without a settings file these defaults hold; a file that leaves a list out has it empty."""

    mode: str = "enforce"
    exclude_dirs: tuple[str, ...] = EXCLUDE_DIRS
    exclude_files: tuple[str, ...] = EXCLUDE_FILES
    threshold: float = THRESHOLD
    thresholds: dict = field(default_factory=dict)
    min_bytes: int = MIN_TOKEN_BYTES
    allow: tuple[str, ...] = ()
    sensitive_names: tuple[str, ...] = SENSITIVE_NAMES
    fallback: str = "report"
    allowed_remotes: tuple[str, ...] = ()
    adjudicate: bool = True
    model: str = ""
    rules: tuple[Rule, ...] = RULES

    @property
    def shadow(self) -> bool:
        return self.mode == "shadow"

    def adjudicator_ready(self, api_key: str | None = None) -> bool:
        """Whether ambiguous findings can be asked about: switched on, with a model or a key."""
        return self.adjudicate and bool(self.model.strip() or api_key)

    def entropy(self) -> dict:
        return {"overrides": self.thresholds, "default": self.threshold, "min_bytes": self.min_bytes, "allow": self.allow}

    def remote_allowed(self, url: str | None) -> bool:
        """No list or no remote allows; else some wildcard must fit."""
        import re

        return not self.allowed_remotes or not url or any(re.search(wildcard_pattern(w), url) for w in self.allowed_remotes)


def _read(path: Path) -> dict:
    text = path.read_text(encoding="utf-8")
    if path.suffix == ".toml":
        return tomllib.loads(text)
    if path.suffix == ".json":
        return json.loads(text)
    import yaml  # only where a YAML file is read

    return yaml.safe_load(text) or {}


def rules_of(path: str | None, base: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """A rule file's rules in place of the built-in ones; these where it can't be read."""
    if not path:
        return base
    try:
        entries = _read(Path(path))["rules"]
        return tuple(Rule(e["id"], e["tier"], float(e["confidence"]), e["pattern"], tuple(e.get("gates", ("",))), int(e.get("group", 1)), e.get("description", "")) for e in entries)
    except (OSError, KeyError, ValueError, TypeError) as e:
        warnings.warn(f"rule file {path!r} not used: {e}", stacklevel=2)
        return base


def load(path: str) -> Settings:
    """Settings from a YAML, TOML or JSON file. Keys it doesn't know are passed over; a file that can't be read leaves the defaults."""
    try:
        d = _read(Path(path))
        lists = lambda k: tuple(d.get(k) or ())
        return Settings(
            mode=d.get("mode", "enforce"), exclude_dirs=lists("exclude_dirs"), exclude_files=lists("exclude_files"), threshold=float(d.get("threshold", THRESHOLD)), thresholds=dict(d.get("thresholds") or {}),
            min_bytes=int(d.get("min_bytes", MIN_TOKEN_BYTES)), allow=lists("allow"), sensitive_names=lists("sensitive_names") or SENSITIVE_NAMES, fallback=d.get("fallback", "report"),
            allowed_remotes=lists("allowed_remotes"), adjudicate=bool(d.get("adjudicate", True)), model=str(d.get("model") or ""), rules=with_custom(list(lists("custom_rules")), rules_of(d.get("rule_file"))),
        )
    except (OSError, ValueError, TypeError, AttributeError, ImportError) as e:
        warnings.warn(f"settings file {path!r} not used: {e}", stacklevel=2)
        return Settings()
