"""Settings merged over defaults, from the first file that exists."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from pathlib import Path

ENV_FILE, FILE_NAME, HOME_DIR = "FOLIOSPARK_CONFIG", "config.json", "foliospark"


@dataclass(frozen=True)
class Config:
    dpi: int = 200
    max_ocr_workers: int = 4
    model_enabled: bool = False
    model_url: str = ""
    model_key: str = ""
    model_name: str = ""


def candidate_paths(env: Mapping[str, str] = os.environ) -> list[Path]:
    named = [Path(env[ENV_FILE].strip()).expanduser()] if env.get(ENV_FILE, "").strip() else []
    return [*named, Path.cwd() / FILE_NAME, Path(__file__).resolve().parents[2] / FILE_NAME, Path.home() / ".config" / HOME_DIR / FILE_NAME]


def _whole(value: object, default: int) -> int:
    try:
        return int(value)
    except (TypeError, ValueError):
        return default


def load(paths: Iterable[Path] | None = None, env: Mapping[str, str] = os.environ) -> Config:
    """A file that cannot be read or parsed counts as empty; dpi is held to 96-600, workers to 1 up."""
    path = next((p for p in (candidate_paths(env) if paths is None else paths) if p.is_file()), None)
    try:
        data = json.loads(path.read_text(encoding="utf-8")) if path else {}
    except (OSError, ValueError):
        data = {}
    sections = {k: data[k] if isinstance(data, dict) and isinstance(data.get(k), dict) else {} for k in ("general", "ai_toc")}
    general, model = sections["general"], sections["ai_toc"]
    return Config(
        dpi=max(96, min(_whole(general.get("dpi", 200), 200), 600)),
        max_ocr_workers=max(1, _whole(general.get("max_ocr_workers", 4), 4)),
        model_enabled=bool(model.get("enabled", False)),
        model_url=env.get("AI_BASE_URL", str(model.get("base_url", ""))),
        model_key=env.get("AI_API_KEY", str(model.get("api_key", ""))),
        model_name=env.get("AI_MODEL", str(model.get("model", ""))),
    )


def worker_profile(profile: str, cpus: int, configured: int | None = None, custom: int | None = None) -> int:
    """Recognition processes for balanced, extreme, eco or custom."""
    balanced = max(1, min(configured or max(2, cpus // 2), cpus))
    sizes = {"balanced": balanced, "extreme": max(2, cpus - 2), "eco": max(1, min(2, cpus // 4)), "custom": max(1, min(custom or balanced, cpus))}
    return sizes[profile]
