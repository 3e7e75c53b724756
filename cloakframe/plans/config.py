"""Settings of detection and redaction, their defaults, loading and validation."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

import numpy as np

from ..functions.hashing import DIGITS
from ..functions.rules import DENYLIST, PATTERNS


class QueryRejected(Exception):
    """The query selects columns that the settings forbid; nothing was run."""


@dataclass(frozen=True)
class Config:
    enabled: bool = True
    denylist: tuple[str, ...] = ()
    allowlist: tuple[str, ...] = ()
    action: str = "mask"  # mask, warn, reject: what query inspection does with denied columns
    wildcard_policy: str = "warn"  # warn, reject
    patterns: dict[str, tuple[str, float]] = field(default_factory=dict)  # name -> (regex, confidence)
    column_name_boost: float = 0.15  # accepted and checked, without effect
    confidence_threshold: float = 0.8
    redaction: str = "[PII:{type}]"
    include_summary: bool = True
    summary_key: str = "_redaction_summary"
    hash_values: bool = False
    hash_salt: str = ""
    hash_digits: int = 8  # 8, 16: of a pseudonym; 8 do not tell many values apart
    mask_results: bool = True
    max_payload_bytes: int = 5 * 1024 * 1024
    stats_enabled: bool = True

    @classmethod
    def from_dict(cls, tree: dict) -> Config:
        """Settings from a nested mapping (as a YAML or JSON file has it); unknown keys are ignored."""
        pii, stream, stats = tree.get("pii", {}), tree.get("stream", {}), tree.get("stats", {})
        names = {"action", "wildcard_policy", "column_name_boost", "confidence_threshold", "redaction", "include_summary", "hash_values", "hash_salt", "hash_digits"}
        got = {k: pii[k] for k in names if k in pii}
        got |= {k: stream[k] for k in ("mask_results", "max_payload_bytes") if k in stream}
        denied = pii.get("column_denylist", pii.get("column_names", ()))
        patterns = {k: (v["regex"], float(v["confidence"])) for k, v in pii.get("patterns", {}).items()}
        return cls(enabled=tree.get("enabled", True), denylist=tuple(denied), allowlist=tuple(pii.get("column_allowlist", ())), patterns=patterns, stats_enabled=stats.get("enabled", True), **got)

    @property
    def denied(self) -> list[str]:
        """Lower-case names: the fixed ones first, then the user's."""
        return list(dict.fromkeys([*DENYLIST, *(x.lower() for x in self.denylist)]))

    @property
    def allowed(self) -> set[str]:
        return {x.lower() for x in self.allowlist}

    def allow(self, *names: str) -> Config:
        return replace(self, allowlist=tuple(dict.fromkeys([*self.allowlist, *names])))

    def disallow(self, *names: str) -> Config:
        return replace(self, allowlist=tuple(x for x in self.allowlist if x not in names))

    def rules(self) -> list[tuple[str, str, float]]:
        """Patterns in order: a user's pattern replaces the first of its name or comes last, by
        name; patterns that do not compile are left out."""
        out = list(PATTERNS)
        for name, (regex, confidence) in sorted(self.patterns.items()):
            if _problem(regex):
                continue
            at = next((k for k, r in enumerate(out) if r[0] == name), None)
            if at is None:
                out.append((name, regex, confidence))
            else:
                out[at] = (name, regex, confidence)
        return out

    def certain(self, confidence: float) -> bool:
        """Whether a match of this confidence masks (single precision, as equal values must)."""
        return bool(np.float32(confidence) >= np.float32(self.confidence_threshold))


def _problem(regex: str) -> str | None:
    try:
        re.compile(regex)
    except re.error as e:
        return str(e)
    if re.search(r"\(\?(?:=|!|<=|<!)|\(\?P=|\\[1-9]", regex):
        return "look-around and back-references are not supported"
    return None


def validate(config: Config) -> tuple[list[str], list[str]]:
    """Errors and notices of the settings."""
    errors, notices = [], []
    for name in ("column_name_boost", "confidence_threshold"):
        if not 0 <= getattr(config, name) <= 1:
            errors.append(f"{name} must lie between 0 and 1")
    if config.action not in ("mask", "warn", "reject"):
        errors.append("action must be mask, warn or reject")
    if config.wildcard_policy not in ("warn", "reject"):
        errors.append("wildcard_policy must be warn or reject")
    if config.hash_digits not in DIGITS:
        errors.append("hash_digits must be 8 or 16")
    for name, (regex, confidence) in sorted(config.patterns.items()):
        if not 0 <= confidence <= 1:
            errors.append(f"pattern {name}: confidence must lie between 0 and 1")
        if problem := _problem(regex):
            errors.append(f"pattern {name}: {problem}")
        if any(name == p[0] for p in PATTERNS):
            notices.append(f"pattern {name} replaces a fixed one")
    return errors, notices
