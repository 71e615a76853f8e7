"""Latin words in Arabic letters."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whole words, letter pairs, single letters.
WORDS = {
    "ok": "أوكي", "okay": "أوكي", "wifi": "واي فاي", "wi-fi": "واي فاي", "hello": "ألو", "hi": "هاي", "app": "آب",
    "email": "إيميل", "iphone": "آيفون", "android": "أندرويد", "windows": "ويندوز", "google": "جوجل",
    "youtube": "يوتيوب", "facebook": "فيسبوك", "deadline": "ديدلاين", "meeting": "ميتينج", "report": "ريبورت",
    "update": "أبديت", "download": "دونلود", "upload": "أبلود", "link": "لينك", "post": "بوست", "story": "ستوري",
}
PAIRS = {
    "sh": "ش", "ch": "تش", "th": "ث", "gh": "غ", "ph": "ف", "kh": "خ", "oo": "و", "ee": "ي", "ck": "ك", "qu": "كو",
}
SINGLE_FROM = "abcdefghijklmnopqrstuvwyz"
SINGLE_TO = "ابكديفجهيجكلمنوبكرستوفويز"
X = "كس"


def _pair_order() -> list[str]:
    """ck before kh: of two pairs that share a letter the left one wins."""
    return sorted(PAIRS, key=lambda p: (p != "ck", p))


def transliterate_word(word: Column) -> Column:
    """A word of ASCII letters in Arabic letters."""
    low = F.lower(word)
    spelled = low
    for pair in _pair_order():
        spelled = F.replace(spelled, F.lit(pair), F.lit(PAIRS[pair]))
    spelled = F.replace(F.translate(spelled, SINGLE_FROM, SINGLE_TO), F.lit("x"), F.lit(X))
    known = F.create_map(*(F.lit(x) for kv in WORDS.items() for x in kv))
    return F.coalesce(F.try_element_at(known, low), spelled)


#: Whole words that are runs of letters, as a pattern and one by one.
_RUNS = [w for w in WORDS if w.isalpha()]
_ALONE = "(?<![a-z])(?:{})(?![a-z])"


def transliterate(text: Column) -> Column:
    """Every run of ASCII letters in Arabic letters, the rest as it is.

    Whole words go first, where there is one; pairs and letters are then exchanged
    in the whole text at once, since no pair reaches over the end of a run.
    """
    low = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    known = low
    for w in _RUNS:
        known = F.regexp_replace(known, _ALONE.format(w), WORDS[w])
    spelled = F.when(low.rlike(_ALONE.format("|".join(_RUNS))), known).otherwise(low)
    for pair in _pair_order():
        spelled = F.replace(spelled, F.lit(pair), F.lit(PAIRS[pair]))
    spelled = F.replace(F.translate(spelled, SINGLE_FROM, SINGLE_TO), F.lit("x"), F.lit(X))
    return F.when(text.rlike("[A-Za-z]"), spelled).otherwise(text)
