"""Scoring parameters and mode presets."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

#: They must equal the published defaults for equal scores.
K1, B = 1.5, 0.75
MODES = {"hybrid": 0.5, "lexical_only": 1.0, "semantic_only": 0.0}
SECTIONS = ("experience", "projects", "skills", "education", "other")
TUNABLE = ("alpha", "gate_threshold", "gate_penalty", "satisfy_threshold", "both_threshold")
ALPHA_SWEEP = (0.0, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 1.0)
GATE_SWEEP = (0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70)


@dataclass(frozen=True)
class Config:
    """One immutable set of parameters; ``tuned`` gives a changed copy."""

    alpha: float = 0.5
    mode: str = "hybrid"
    lexical_field: str = "expanded"
    k1: float = K1
    b: float = B
    gate_threshold: float = 0.45
    gate_penalty: float = 0.75
    satisfy_threshold: float = 0.5
    both_threshold: float = 0.0
    score_min: float = 0.0
    score_max: float = 100.0

    def tuned(self, **changes: object) -> "Config":
        """A copy with other values; unknown names and non-numbers are rejected."""
        known = {f.name for f in fields(self)}
        for name, value in changes.items():
            if name not in known:
                raise ValueError(f"unknown parameter {name}")
            if name in TUNABLE and (isinstance(value, bool) or not isinstance(value, (int, float))):
                raise ValueError(f"{name} must be a number")
        if changes.get("lexical_field", self.lexical_field) not in ("expanded", "normalized"):
            raise ValueError("lexical_field must be expanded or normalized")
        return replace(self, **changes)


def preset(mode: str) -> Config:
    """The configuration of a mode; an unknown mode is an error."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; one of {', '.join(MODES)}")
    return Config(mode=mode, alpha=MODES[mode])
