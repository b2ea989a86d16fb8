"""Project configuration: JSON file, ignore files, overrides."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from pathlib import Path

from palisade.catalogue import RULES, SEVERITIES, FunctionRule, Rule, active_rules
from palisade.functions.text import SPACE_CHARS

# What is ignored by default, and the words marking test code.
DEFAULT_IGNORES = ("dist/**", "build/**", "node_modules/**", "coverage/**")
TEST_WORDS = ("test", "spec", "fixtures")
DEFAULT_THRESHOLD = "high"

PREFIX = "palisade"
CONFIG_FILES = (f".{PREFIX}rc.json", f".{PREFIX}rc", f"{PREFIX}.config.json")
IGNORE_FILES = (".gitignore", f".{PREFIX}ignore")


@dataclass(frozen=True)
class ScanConfig:
    """``min_entropy=None`` keeps each rule's own threshold; a number overrides all."""

    ignore_paths: tuple[str, ...] = DEFAULT_IGNORES
    disabled_rules: tuple[str, ...] = ()
    severity_overrides: dict[str, str] = field(default_factory=dict)
    min_entropy: float | None = None
    fail_threshold: str = DEFAULT_THRESHOLD
    directive_prefix: str = PREFIX
    strict_ids: bool = False
    custom_rules: tuple[Rule, ...] = ()
    builtin_rules: tuple[Rule, ...] = RULES
    function_rules: tuple[FunctionRule, ...] = ()

    def __post_init__(self) -> None:
        for severity in (self.fail_threshold, *self.severity_overrides.values()):
            if severity not in SEVERITIES:
                raise ValueError(f"unknown severity: {severity}")

    @property
    def rules(self) -> tuple[Rule, ...]:
        return active_rules(
            self.builtin_rules, self.custom_rules, self.disabled_rules, self.severity_overrides,
            self.min_entropy,
        )

    @property
    def functions(self) -> tuple[FunctionRule, ...]:
        """Active rules written in Python; they come after all others."""
        return active_rules(
            self.function_rules, (), self.disabled_rules, self.severity_overrides, None
        )

    def with_least_entropy(self, bits: float) -> ScanConfig:
        return replace(self, min_entropy=bits)

    def including_tests(self) -> ScanConfig:
        kept = tuple(p for p in self.ignore_paths if not any(w in p for w in TEST_WORDS))
        return replace(self, ignore_paths=kept)


def ignore_lines(text: str) -> list[str]:
    stripped = (line.strip(SPACE_CHARS) for line in text.replace("\r\n", "\n").split("\n"))
    return [line for line in stripped if line and not line.startswith("#")]


def union_patterns(*groups: Iterable[str]) -> tuple[str, ...]:
    return tuple(dict.fromkeys(p for group in groups for p in group))


def _read(path: Path) -> str | None:
    try:
        return path.read_text(encoding="utf-8")
    except (OSError, UnicodeDecodeError):
        return None


def load_config(root: str | Path = ".") -> ScanConfig:
    """First parsable config file wins; ignore files add their patterns."""
    root = Path(root)
    found: dict = {}
    for name in CONFIG_FILES:
        text = _read(root / name)
        if text is None:
            continue
        try:
            parsed = json.loads(text)
        except json.JSONDecodeError:
            continue
        found = parsed if isinstance(parsed, dict) else {}
        break
    listed = found.get("ignorePaths")
    disabled = found.get("disabledRules")
    entropy = found.get("minEntropy")
    extra = [ignore_lines(text) for name in IGNORE_FILES if (text := _read(root / name))]
    return ScanConfig(
        ignore_paths=union_patterns(
            DEFAULT_IGNORES, listed if isinstance(listed, list) else (), *extra
        ),
        disabled_rules=tuple(disabled) if isinstance(disabled, list) else (),
        severity_overrides=dict(found.get("severityOverrides") or {}),
        min_entropy=(
            float(entropy)
            if isinstance(entropy, (int, float)) and not isinstance(entropy, bool)
            else None
        ),
        fail_threshold=found.get("failThreshold") or DEFAULT_THRESHOLD,
    )
