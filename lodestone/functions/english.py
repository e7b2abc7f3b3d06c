"""English lexemes: words in lower case, without stop words, as stems of the Snowball algorithm for English (Porter2)."""

from __future__ import annotations

import re

#: The words that English full-text search leaves out.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
    they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having
    do does did doing a an the and but if or because as until while of at by for with about against between into through during
    before after above below to from up down in out on off over under again further then once here there when where why how all any
    both each few more most other some such no nor not only own same so than too very s t can will just don should now""".split()
)

#: Words whose stems no rule gives, and words that are their own stems, from the start or after plurals.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
SETTLED = frozenset("inning outing canning herring earring proceed exceed succeed".split())

#: Endings of the steps, and what takes their place within the first or the second region.
DERIVED = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
DERIVED_AGAIN = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
DROPPED = dict.fromkeys("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split(), "")

_WORD = re.compile(r"[^\W_]+(?:_+[^\W_]+)*")
_REGION = re.compile(r"[aeiouy][^aeiouy]")
_SHORT_END = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
_VOWEL = re.compile(r"[aeiouy]")


#: Endings of past and progressive forms; the length of the longest ending of any step.
PAST = frozenset(("eed", "eedly", "ed", "edly", "ing", "ingly"))
LONGEST = max(map(len, (*DERIVED, *DERIVED_AGAIN, *DROPPED, *PAST)))


def _ending(word: str, endings) -> str | None:
    """The longest that the word has."""
    for k in range(-LONGEST, 0):
        if word[k:] in endings:
            return word[k:]
    return None


def stem(word: str) -> str:
    """Of a word in lower case."""
    if len(word) <= 2:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    # a y that stands for a consonant
    if "y" in word:
        word = re.sub(r"(?<=[aeiouy])y", "Y", re.sub(r"^y", "Y", word))
    fixed = re.match(r"gener|commun|arsen", word)
    found = fixed or _REGION.search(word)
    first = found.end() if found else len(word)
    found = _REGION.search(word, first)
    second = found.end() if found else len(word)

    # plurals
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and _VOWEL.search(word[:-2]):
        word = word[:-1]
    if word in SETTLED:
        return word

    # past and progressive forms
    end = _ending(word, PAST)
    if end in ("eed", "eedly"):
        if len(word) - len(end) >= first:
            word = word[: -len(end)] + "ee"
    elif end and _VOWEL.search(word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", word):
            word = word[:-1]
        elif len(word) <= first and _SHORT_END.search(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"

    # endings of derivation
    end = _ending(word, DERIVED)
    if end and len(word) - len(end) >= first:
        before = word[: -len(end)]
        if (end != "ogi" or before.endswith("l")) and (end != "li" or before[-1:] in tuple("cdeghkmnrt")):
            word = before + DERIVED[end]
    end = _ending(word, DERIVED_AGAIN)
    if end and len(word) - len(end) >= (second if end == "ative" else first):
        word = word[: -len(end)] + DERIVED_AGAIN[end]
    end = _ending(word, DROPPED)
    if end and len(word) - len(end) >= second and (end != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(end)]

    # a last e or l
    if word.endswith("e"):
        if len(word) > second or len(word) > first and not _SHORT_END.search(word[:-1]):
            word = word[:-1]
    elif word.endswith("ll") and len(word) > second:
        word = word[:-1]
    return word.replace("Y", "y")


class Stems(dict):
    """Word -> stem; none for a stop word. A memo that is emptied when it grows too large."""

    LIMIT = 400_000

    def __missing__(self, word: str) -> str | None:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = None if word in STOP_WORDS else stem(word) if word.isalpha() else word
        return value


class Numbers(dict):
    """Word -> number of its stem, -1 for a stop word; `names` has the stems by number."""

    LIMIT = 400_000

    def __init__(self):
        super().__init__()
        self.names: list[str] = []
        self._known: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        said = None if word in STOP_WORDS else stem(word) if word.isalpha() else word
        value = self[word] = -1 if said is None else self._known.setdefault(said, len(self.names))
        if value == len(self.names):
            self.names.append(said)
        return value

    def trim(self) -> None:
        """Start afresh if it has grown too large. Numbers given before no longer count."""
        if len(self) > self.LIMIT:
            self.clear()
            self.names.clear()
            self._known.clear()


def words(text: str) -> list[str]:
    """Runs of letters and digits, perhaps joined by low lines, in lower case."""
    return _WORD.findall(text.lower())


def lexemes(text: str, memo: Stems | None = None) -> list[tuple[str, int]]:
    """(stem, place among all words from 1) of the words of a text that aren't stop words."""
    memo = Stems() if memo is None else memo
    return [(s, k) for k, w in enumerate(words(text), 1) if (s := memo[w]) is not None]


def surely_in(lexeme: str) -> str:
    """What every word with this stem begins with: endings give way to others of the same first letter, but for `bility` and irregular words."""
    return lexeme[: max(1, len(lexeme) - (2 if lexeme.endswith("le") or lexeme in IRREGULAR.values() else 1))]
