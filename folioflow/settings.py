"""Settings from the environment, with defaults, or from a session's configuration."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


def unquoted(value: str) -> str:
    """A value without outer blanks and one pair of matching quotes."""
    value = value.strip()
    return value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value


@dataclass(frozen=True)
class Settings:
    """Limits of the recognition pipeline (defaults are fixed values)."""

    max_upload_bytes: int = 10 * 1024 * 1024
    max_image_pixels: int = 20_000_000
    least_image_side: int = 32
    focus_threshold: float = 80.0
    candidate_trigger: float = 72.0
    primary_bias: float = 3.0
    sparse_foreground: float = 0.035
    dev_fraction: float = 0.1
    max_label_length: int = 25

    def __post_init__(self) -> None:
        if not 0 < self.dev_fraction < 0.5:
            raise ValueError("dev_fraction must be in (0, 0.5)")
        if self.max_upload_bytes < 1 or self.max_label_length < 1:
            raise ValueError("limits must be positive")

    @classmethod
    def load(cls, environment: Mapping[str, str] | None = None, prefix: str = "FOLIOFLOW_") -> Settings:
        """Fields named ``PREFIX_FIELD``; absent and blank ones keep their default, others are cast to its type."""
        environment = os.environ if environment is None else environment
        given = {}
        for f in fields(cls):
            value = unquoted(environment.get(prefix + f.name.upper(), ""))
            if value:
                given[f.name] = type(f.default)(value)
        return cls(**given)
