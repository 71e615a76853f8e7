"""Numbers as spoken Arabic words, in two styles.

Whole numbers are arithmetic over small tables, so they are Column expressions;
only the rewriting of numbers inside running text needs a Python worker.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Number words of the spoken (egy) and the standard (msa) style.
UNITS = {
    "egy": "واحد اتنين تلاتة أربعة خمسة ستة سبعة تمانية تسعة".split(),
    "msa": "واحد اثنين ثلاثة أربعة خمسة ستة سبعة ثمانية تسعة".split(),
}
TEN = "عشرة"
TEENS = {
    "egy": "حداشر اتناشر تلتاشر اربعتاشر خمستاشر ستاشر سبعتاشر تمنتاشر تسعتاشر".split(),
    "msa": [f"{x} عشر" for x in "أحد اثنا ثلاثة أربعة خمسة ستة سبعة ثمانية تسعة".split()],
}
TENS = {
    "egy": "عشرين تلاتين أربعين خمسين ستين سبعين تمانين تسعين".split(),
    "msa": "عشرون ثلاثون أربعون خمسون ستون سبعون ثمانون تسعون".split(),
}
HUNDREDS = {
    "egy": "مية ميتين تلاتمية اربعمية خمسمية ستمية سبعمية تمانمية تسعمية".split(),
    "msa": "مائة مئتان ثلاثمائة أربعمائة خمسمائة ستمائة سبعمائة ثمانمائة تسعمائة".split(),
}
#: one, two, three to ten, more
SCALES = {
    "egy": (
        ("ألف", "ألفين", "آلاف", "ألف"),
        ("مليون", "مليونين", "ملايين", "مليون"),
        ("مليار", "مليارين", "مليارات", "مليار"),
    ),
    "msa": (
        ("ألف", "ألفان", "آلاف", "ألف"),
        ("مليون", "مليونان", "ملايين", "مليون"),
        ("مليار", "ملياران", "مليارات", "مليار"),
    ),
}
ZERO, AND, POINT, HALF, DOT, PERCENT = "صفر", " و", "فاصل", "ونص", "نقطة", "في المية"
EASTERN_DIGITS = "٠١٢٣٤٥٦٧٨٩"


def hundred_words(style: str) -> list[str]:
    """Words of 0 to 99; 0 is empty."""
    out = ["", *UNITS[style], TEN, *TEENS[style]]
    for ten in TENS[style]:
        out += [ten, *(f"{unit}{AND}{ten}" for unit in UNITS[style])]
    return out


def _pick(table: list[str], index: Column) -> Column:
    return F.get(F.array(*(F.lit(x) for x in table)), index.cast("int"))


def below_thousand(n: Column, style: str) -> Column:
    """Words of 0 to 999; 0 is empty, more is null."""
    hundreds = F.when(n >= 100, _pick(["", *HUNDREDS[style]], F.floor(n / 100)))
    rest = F.when(n % 100 > 0, _pick(hundred_words(style), n % 100))
    return F.when((n >= 0) & (n < 1000), F.concat_ws(AND, hundreds, rest))


def _scaled(n: Column, forms: tuple[str, str, str, str], style: str) -> Column:
    one, two, few, many = forms
    return (
        F.when(n == 1, one)
        .when(n == 2, two)
        .when((n >= 3) & (n <= 10), F.concat(_pick(hundred_words(style), n), F.lit(f" {few}")))
        .when(n > 10, F.concat(below_thousand(n, style), F.lit(f" {many}")))
    )


def number_words(n: Column, style: str = "egy") -> Column:
    """A whole number below 10**12 in words; negative and larger numbers are null."""
    n = n.cast("long")
    thousand, million, milliard = SCALES[style]
    parts = [
        _scaled(F.floor(n / 10**9), milliard, style),
        _scaled(F.floor(n / 10**6) % 1000, million, style),
        _scaled(F.floor(n / 1000) % 1000, thousand, style),
        F.when(n % 1000 > 0, below_thousand(n % 1000, style)),
    ]
    return F.when(n == 0, ZERO).when((n > 0) & (n < 10**12), F.concat_ws(AND, *parts))


def digit_words(digits: Column, style: str = "egy") -> Column:
    """A string of digits read one by one."""
    chars = F.filter(F.split(digits, ""), lambda c: c != "")
    return F.array_join(F.transform(chars, lambda c: _pick([ZERO, *UNITS[style]], c.cast("int"))), " ")


def decimal_words(whole: Column, fraction: Column, style: str = "egy") -> Column:
    """whole.fraction in words: .5 is a half, else the digits after the point are read out.

    A whole part of 1000 or more has no reading (null).
    """
    spoken = below_thousand(whole.cast("long"), style)
    half = F.regexp_replace(fraction, "0+$", "") == "5"
    return F.when(half, F.trim(F.concat(spoken, F.lit(f" {HALF}")))).otherwise(
        F.concat(spoken, F.lit(f" {POINT} "), digit_words(fraction, style))
    )


def eastern_to_ascii(text: Column) -> Column:
    return F.translate(text, EASTERN_DIGITS, "0123456789")


def _say_below_thousand(n: int, style: str) -> str:
    if n >= 1000:
        raise ValueError("no reading for a thousand or more here")
    table = hundred_words(style)
    return AND.join(x for x in (HUNDREDS[style][n // 100 - 1] if n >= 100 else "", table[n % 100]) if x)


def _say(n: int, style: str) -> str:
    if n == 0:
        return ZERO
    groups = [(n % 1000, None)]
    for forms in SCALES[style]:
        n //= 1000
        groups.append((n % 1000 if forms is not SCALES[style][-1] else n, forms))
    out = []
    for k, forms in reversed(groups):
        if not k:
            continue
        if forms is None:
            out.append(_say_below_thousand(k, style))
        elif k <= 2:
            out.append(forms[k - 1])
        else:
            out.append(f"{_say_below_thousand(k, style)} {forms[2] if k <= 10 else forms[3]}")
    return AND.join(out)


def _say_digits(digits: str, style: str) -> str:
    return " ".join((ZERO, *UNITS[style])[int(c)] for c in digits)


def _say_decimal(number: str, style: str) -> str:
    whole, fraction = number.split(".")
    spoken = _say_below_thousand(int(whole), style)
    if fraction.rstrip("0") == "5":
        return f"{spoken} {HALF}".strip()
    return f"{spoken} {POINT} {_say_digits(fraction, style)}"


#: What is rewritten, in this order; each step sees what the one before it left.
_STEPS = (
    (re.compile(r"\b\d{1,3}(?:,\d{3})+\b"), lambda s, style: s.replace(",", "")),
    (
        re.compile(r"\d+(?:\.\d+)?\s*[%٪]"),
        lambda s, style: f"{_percent(s.rstrip('%٪').rstrip(), style)} {PERCENT}",
    ),
    (re.compile(r"\b\d+(?:\.\d+){2,}\b"), lambda s, style: f" {DOT} ".join(_say_digits(g, style) for g in s.split("."))),
    (re.compile(r"(?<![\d.])\d+\.\d+(?![\d.])"), lambda s, style: f" {_say_decimal(s, style)} "),
    (re.compile(r"\d+"), lambda s, style: f" {_say(int(s), style)} "),
)


def _percent(number: str, style: str) -> str:
    if "." in number:
        return _say_decimal(number, style)
    return _say_below_thousand(int(number), style) or ZERO


_DIGIT = re.compile(r"\d")
#: Digits of numbers that have no reading, until all others are read.
_HELD = str.maketrans("0123456789", "".join(chr(0xE000 + i) for i in range(10)))
_RELEASED = str.maketrans("".join(chr(0xE000 + i) for i in range(10)), "0123456789")


def speak_numbers(text: str | None, style: str = "egy") -> str | None:
    """All numbers of a text in words: grouped thousands, percents, dotted runs, decimals, whole numbers.

    A percentage or a decimal of 1000 or more and a number of thousands of digits
    have no reading and stay as they are written.
    """
    if text is None:
        return None

    def spoken(m: re.Match, say) -> str:
        try:
            return say(m.group(), style)
        except (ValueError, IndexError):
            return m.group().translate(_HELD)

    if _DIGIT.search(text):
        for pattern, say in _STEPS:
            text = pattern.sub(lambda m, say=say: spoken(m, say), text)
    return " ".join(text.translate(_RELEASED).split())


def speak_numbers_udf(style: str = "egy"):
    """speak_numbers over a column, a batch at a time."""

    @F.pandas_udf(StringType())
    def speak(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: speak_numbers(t, style))

    return speak
