"""Settings of an index from a TOML file, and the stages of a run."""

from __future__ import annotations

import tomllib
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path

#: Kinds of chunks. Fixed values.
SOURCES = ("post", "quote", "article", "link", "image", "video")


@dataclass(frozen=True)
class Settings:
    """Sources that stay out of the index, and whether translated chunks are indexed in English."""

    exclude: frozenset[str] = frozenset()
    translate: bool = True


def known(sources: Iterable[str]) -> frozenset[str]:
    """The sources as a set; one that doesn't exist is an error."""
    named = frozenset(sources)
    if not named <= frozenset(SOURCES):
        raise ValueError(f"unknown sources: {', '.join(sorted(named - frozenset(SOURCES)))}")
    return named


def settings(path: str | Path) -> Settings:
    """The settings of a file; those of a missing file are the defaults."""
    place = Path(path)
    read = tomllib.loads(place.read_text()) if place.exists() else {}
    return Settings(known(read.get("exclude", ())), bool(read.get("translate", True)))


def resolved(base: Settings, *, exclude: Iterable[str] = (), translate: bool | None = None) -> Settings:
    """The settings of a run: its own exclusions come on top of the file's, its own choice of translation goes before it."""
    return Settings(base.exclude | known(exclude), base.translate if translate is None else translate)


def now_iso() -> str:
    return datetime.now(UTC).isoformat(timespec="seconds")


def run_id() -> str:
    return datetime.now(UTC).strftime("%Y%m%dT%H%M%SZ")


def run_stages(stages: Iterable[tuple[str, Callable[[], object]]]) -> list[dict]:
    """Run named stages one after the other, the rest also after a failure: {stage, outcome, error} of each."""
    made = []
    for name, stage in stages:
        try:
            stage()
            made.append({"stage": name, "outcome": "ok", "error": None})
        except Exception as e:  # noqa: BLE001
            made.append({"stage": name, "outcome": "failed", "error": (str(e).splitlines() or [type(e).__name__])[0][:200]})
    return made
