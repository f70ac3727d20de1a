"""Settings of a run, kept as a JSON object. They stay on the driver."""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import asdict, dataclass, fields
from pathlib import Path

from cuelake.sources.subtitles import ENCODINGS

CHOICES = {
    "output_mode": ("bilingual", "translated"),
    "hallucination_filter": ("off", "conservative", "aggressive"),
    "existing": ("reuse", "force", "retry_no_text"),
    "srt_encoding": ENCODINGS,
    "provider": ("offline", "openai_compatible"),
    "response_format": ("text", "json_object", "json_schema"),
}
LEAST = {"batch": 1, "retries": 1, "sleep": 0.0, "request_timeout_seconds": 0.001, "dedupe_window_seconds": 0.0}
#: Settings for which a wrong choice is an error; elsewhere the default is taken.
STRICT = ("provider", "response_format")


@dataclass(frozen=True)
class Settings:
    source_language: str = "auto"
    target_language: str = "zh-CN"
    output_mode: str = "bilingual"
    srt_encoding: str = "auto"
    hallucination_filter: str = "off"
    dedupe_window_seconds: float = 0.1
    existing: str = "reuse"
    provider: str = "offline"
    model: str = ""
    base_url: str = ""
    response_format: str = "text"
    batch: int = 20
    retries: int = 3
    sleep: float = 1.0
    request_timeout_seconds: float = 60.0


def load(path: str | Path) -> Settings:
    """Settings of a file: unknown names are dropped, values of the wrong kind or out of range give way to defaults."""
    try:
        saved = json.loads(Path(path).read_text(encoding="utf-8-sig"))
    except FileNotFoundError:
        return Settings()
    if not isinstance(saved, dict):
        raise ValueError("settings are a JSON object")
    held = {}
    for field in fields(Settings):
        name, value = field.name, saved.get(field.name, field.default)
        if name in STRICT and value not in CHOICES[name]:
            raise ValueError(f"unknown {name}: {value!r}")
        if isinstance(field.default, float) and type(value) is int:
            value = float(value)
        fits = type(value) is type(field.default) and value in CHOICES.get(name, (value,))
        if fits and (name not in LEAST or LEAST[name] <= value < float("inf")):
            held[name] = value
    return Settings(**held)


def save(settings: Settings, path: str | Path) -> None:
    """Written beside the file first, then put in its place."""
    path = Path(path)
    draft = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    try:
        draft.write_text(json.dumps(asdict(settings), ensure_ascii=False, indent=2) + "\n", encoding="utf-8")
        os.replace(draft, path)
    finally:
        draft.unlink(missing_ok=True)
