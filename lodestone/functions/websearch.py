"""Questions as people type them into a search field: words, "phrases", `or`, and `-` for what must not occur."""

from __future__ import annotations

import re
from dataclasses import dataclass

from .english import STOP_WORDS, Stems, words


@dataclass(frozen=True)
class Phrase:
    """Lexemes at fixed distances: (lexeme, words after the first one)."""

    terms: tuple[tuple[str, int], ...]
    negated: bool = False


@dataclass(frozen=True)
class Question:
    """Any of some alternatives, each of phrases that must all occur, or must not."""

    alternatives: tuple[tuple[Phrase, ...], ...]

    @property
    def phrases(self) -> list[Phrase]:
        """Each different run of lexemes once, whether wanted or not."""
        return [Phrase(t) for t in dict.fromkeys(p.terms for a in self.alternatives for p in a)]

    @property
    def lexemes(self) -> list[str]:
        return sorted({lexeme for p in self.phrases for lexeme, _ in p.terms})


_PIECE = re.compile(r'(-?)"([^"]*)"?|(\S+)')


def _phrase(text: str, memo: Stems, negated: bool) -> Phrase | None:
    """Stop words keep their places between others; none is left of a text of stop words."""
    placed = [(memo[w], k) for k, w in enumerate(words(text)) if w not in STOP_WORDS]
    return Phrase(tuple((lexeme, k - placed[0][1]) for lexeme, k in placed), negated) if placed else None


def parse(question: str) -> Question:
    """Words stand for all of them, `or` for one side or the other, a minus at the beginning of a word or phrase for its absence.

    A word with marks inside, such as `surface-code`, is a phrase of its parts. Nothing is an error:
    open quotation marks end with the text, other marks are skipped, alternatives without lexemes vanish.
    """
    memo, alternatives = Stems(), [[]]
    for minus, quoted, word in _PIECE.findall(question):
        if word.lower() == "or":
            alternatives.append([])
            continue
        negated = minus == "-" or word.startswith("-")
        found = _phrase(word or quoted, memo, negated)
        if found and found not in alternatives[-1]:
            alternatives[-1].append(found)
    return Question(tuple(dict.fromkeys(tuple(a) for a in alternatives if a)))
