"""Settings of the engine, from the environment or a .env file; all faults are reported at once."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from pathlib import Path

PREFIX = "QUIRELAKE_"
TRUE = ("1", "true", "yes")


@dataclass(frozen=True)
class Config:
    device: str = "cpu"
    ocr_threads: int = 4
    line_workers: int = 4
    page_workers: int = 2
    height_scale: float = 1.0
    max_width: int = 1600
    adaptive: bool = True
    arena: bool = True
    role_classifier: bool = False
    results_dir: str = "results"
    max_age_hours: int = 24
    max_upload_mb: int = 256
    max_pixels: int = 300_000_000
    max_queue: int = 16
    spool_dir: str = ""

    def __post_init__(self) -> None:
        bad = [f"{n} must be over 0" for n in ("ocr_threads", "line_workers", "page_workers", "max_width", "max_age_hours", "max_upload_mb", "max_pixels", "max_queue") if not isinstance(getattr(self, n), int) or isinstance(getattr(self, n), bool) or getattr(self, n) <= 0]
        if self.device not in ("cpu", "cuda", "auto"):
            bad.append("device must be cpu, cuda or auto")
        if not 0.1 <= self.height_scale <= 10:
            bad.append("height_scale must lie in [0.1, 10]")
        if self.spool_dir and not Path(self.spool_dir).is_dir():
            bad.append("spool_dir isn't a folder")
        if bad:
            raise ValueError("; ".join(bad))

    def resolve_device(self, available: list[str] | None = None) -> str:
        """auto is cuda where the runtime offers it."""
        if self.device != "auto":
            return self.device
        return "cuda" if any("CUDA" in a.upper() for a in available or []) else "cpu"

    @property
    def results_path(self) -> Path:
        return Path(self.results_dir)


def load_env(env: dict[str, str] | None = None, dotenv: str | Path | None = None) -> Config:
    """Typed settings by field name in capitals after PREFIX; a .env file never overrides what the environment has."""
    given: dict[str, str] = {}
    if dotenv and Path(dotenv).is_file():
        for line in Path(dotenv).read_text(encoding="utf-8").splitlines():
            key, eq, value = line.strip().partition("=")
            if eq and not key.startswith("#"):
                given[key.strip()] = value.strip().strip("\"'")
    given |= dict(os.environ if env is None else env)
    kinds = {"bool": lambda v: v.strip().lower() in TRUE, "int": int, "float": float, "str": str}
    return Config(**{f.name: kinds[str(f.type)](given[PREFIX + f.name.upper()]) for f in fields(Config) if PREFIX + f.name.upper() in given})
