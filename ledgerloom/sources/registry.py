"""The known sources, in the order in which they are looked for."""

from __future__ import annotations

from ledgerloom.sources import claude_code, codex, copilot, gemini
from ledgerloom.sources.base import Source, env_paths

#: Detected only: its logs hold hardly any counts.
CURSOR = Source("cursor", lambda: env_paths("CURSOR_HOME", "~/.cursor", ""))
SOURCES: dict[str, Source] = {s.id: s for s in (claude_code.SOURCE, codex.SOURCE, gemini.SOURCE, copilot.SOURCE, CURSOR)}


def by_id(name: str) -> Source:
    if name not in SOURCES:
        raise ValueError(f"unknown agent {name!r}; known: {', '.join(SOURCES)}")
    return SOURCES[name]


def detect() -> Source | None:
    """The first source that has a folder here."""
    return next((s for s in SOURCES.values() if s.detect()), None)


def route(agent: str | None = None, default: str | None = None) -> Source:
    """The source named, else the configured one, else the one detected."""
    if agent or default:
        return by_id(agent or default)
    if (found := detect()) is None:
        raise LookupError(f"no logs of any agent found; known: {', '.join(SOURCES)}")
    return found
