"""Engine options with their bounds, and where they come from."""

from __future__ import annotations

import math
import os
from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path
from urllib.parse import urlsplit


@dataclass(frozen=True)
class Settings:
    """Options of an ingestion; values out of bounds raise ValueError."""

    data_dir: str = "data"
    model_base_url: str = "http://localhost:8000/v1"
    model: str = "vision-model"
    model_revision: str = "unpinned"
    api_key: str = ""
    timeout_seconds: float = 300.0
    max_tokens: int = 4096
    image_max_side: int = 1800
    pdf_dpi: int = 350
    min_candidate_score: float = 0.35
    min_model_score: float = 0.65

    def __post_init__(self) -> None:
        within = {"max_tokens": (1, 65536), "image_max_side": (128, 16384), "pdf_dpi": (72, 1200), "min_candidate_score": (0, 1), "min_model_score": (0, 1), "timeout_seconds": (0, 3600)}
        for name, (low, high) in within.items():
            value = getattr(self, name)
            if isinstance(value, bool) or not math.isfinite(value) or not low <= value <= high or (name == "timeout_seconds" and value == 0):
                raise ValueError(f"{name} must be between {low} and {high}")
        parts = urlsplit(self.model_base_url)
        if parts.scheme not in ("http", "https") or not parts.hostname:
            raise ValueError("model_base_url must be http or https")
        if not self.model or not self.model_revision:
            raise ValueError("model and model_revision must not be empty")
        object.__setattr__(self, "model_base_url", self.model_base_url.rstrip("/"))
        object.__setattr__(self, "data_dir", str(Path(self.data_dir).expanduser().resolve()) if "://" not in self.data_dir else self.data_dir.rstrip("/"))

    @classmethod
    def from_env(cls, environ: Mapping[str, str] | None = None, prefix: str = "BANDLOOM_", **given) -> Settings:
        """Values given, then those of the environment (prefix and the name in capitals), then defaults."""
        environ = os.environ if environ is None else environ
        kinds = {"int": int, "float": float, "str": str}
        found = {f.name: kinds[f.type](environ[prefix + f.name.upper()]) for f in fields(cls) if prefix + f.name.upper() in environ}
        return cls(**(found | given))

    @property
    def model_version(self) -> str:
        return f"{self.model}@{self.model_revision}"

    def __repr__(self) -> str:
        shown = ", ".join(f"{f.name}={getattr(self, f.name)!r}" for f in fields(self) if f.name != "api_key")
        return f"Settings({shown}, api_key=***)"
