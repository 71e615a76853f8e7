"""Letters and their marks as two aligned label sequences, and back."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

from corpusloom.functions.repair import SHADDA, strip

NONE = "<NONE>"
_LIGATURES = str.maketrans({"ﻻ": "لا", "ﻷ": "لأ", "ﻹ": "لإ", "ﻵ": "لآ", "ٱ": "ا", "ـ": "", "ٰ": ""})


def clean(text: str) -> str:
    """Arabic letters and short marks; ligatures opened, tatweel and dagger alef gone."""
    return " ".join(re.sub("[^ء-غف-يً-ْ ]", " ", text.translate(_LIGATURES)).split())


def split(text: str) -> list[tuple[str, str]]:
    """(letter, marks) for every letter and space; a shadda comes first, repeated marks count once."""
    out: list[tuple[str, str]] = []
    for letter, marks in re.findall("([^ً-ْ])([ً-ْ]*)", clean(text)):
        kinds = sorted(dict.fromkeys(marks), key=lambda m: m != SHADDA)
        vowel = [m for m in kinds if m != SHADDA][:1]
        label = (SHADDA if SHADDA in kinds else "") + "".join(vowel)
        out.append((letter, label or NONE))
    return out


def join(pairs: list[tuple[str, str]]) -> str:
    return "".join(a + ("" if m == NONE else m) for a, m in pairs)


def without_case_endings(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The last letter of each word without its mark (a shadda stays)."""
    out = []
    for i, (a, m) in enumerate(pairs):
        last = a != " " and (i + 1 == len(pairs) or pairs[i + 1][0] == " ")
        out.append((a, (SHADDA if SHADDA in m else NONE) if last else m))
    return out


class Labels:
    """Ids of letters and of mark labels, in order of frequency in a sample."""

    def __init__(self, texts: list[str]):
        letters, marks = Counter(), Counter()
        for t in texts:
            for a, m in split(t):
                letters[a] += 1
                marks[m] += 1
        order = lambda c: ["<PAD>", "<BOS>", "<EOS>", *sorted(c, key=lambda k: (-c[k], k))]
        self.letters, self.marks = order(letters), order(marks)
        self._l, self._m = ({k: i for i, k in enumerate(x)} for x in (self.letters, self.marks))

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        pairs = split(text)
        return [1, *(self._l[a] for a, _ in pairs), 2], [1, *(self._m[m] for _, m in pairs), 2]

    def decode(self, letters: list[int], marks: list[int]) -> str:
        return join([(self.letters[a], self.marks[m]) for a, m in zip(letters[1:-1], marks[1:-1], strict=True)])


def safety_check(listed: dict[str, int], key: Callable[[str], tuple]) -> Callable[[str], list[tuple[int, str, str]]]:
    """A check of vocalised words against listed ones (word: tier): by spelling, or by sound with another spelling."""
    bare = {strip(w): t for w, t in listed.items()}
    sounds: dict[tuple, tuple[int, str]] = {}
    for w, t in listed.items():
        sounds.setdefault(key(w), (t, strip(w)))

    def check(word: str) -> list[tuple[int, str, str]]:
        if not word:
            return []
        spelled = strip(word).strip('.,!?؟؛،:"()«»')
        hits = [(bare[spelled], spelled, "spelling")] if spelled in bare else []
        sound = sounds.get(key(word))
        if sound and sound[1] != spelled:
            hits.append((*sound, "phoneme"))
        return hits

    return check
