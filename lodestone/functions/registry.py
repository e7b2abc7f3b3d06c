"""Named things that callers may add to: sources of papers, sources of discourse, ways to shortlist, judges of a job."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any


class Registry:
    """Names in order of entry; a name is taken once."""

    def __init__(self, what: str):
        self.what = what
        self._held: dict[str, Any] = {}

    def register(self, name: str, thing: Any) -> None:
        if not name.strip():
            raise ValueError(f"a {self.what} needs a name")
        if name in self._held:
            raise ValueError(f"{self.what} {name} is there already")
        self._held[name] = thing

    def get(self, name: str) -> Any:
        if name not in self._held:
            raise KeyError(f"no {self.what} {name}; there are {', '.join(self._held) or 'none'}")
        return self._held[name]

    def names(self) -> list[str]:
        return list(self._held)


#: The two kinds of sources are kept apart: what a community says never becomes evidence.
EVIDENCE_SOURCES, DISCOURSE_SOURCES = Registry("source of papers"), Registry("source of discourse")
SHORTLISTS, JUDGES = Registry("shortlist"), Registry("judge")


def ask(job: str, messages: list[dict[str, str]], judges: Registry = JUDGES, default: Callable | None = None) -> Any:
    """The answer of the job's judge, or of the default one; what goes wrong in it names the job."""
    judge = judges.get(job) if job in judges.names() or default is None else default
    try:
        return judge(messages)
    except Exception as e:
        raise RuntimeError(f"the judge of {job} failed: {e}") from e
