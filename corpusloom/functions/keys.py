"""Cleaning and key functions on Arabic text: Column in, Column out.

All of them give null for null. White space follows Unicode where noted with (?U).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points of marks, letters and punctuation.
MARKS = "ً-ٰٕ"
LETTERS = "ء-غف-ي"
LETTERS_TATWEEL = "ء-ي"
EDGE_PUNCT = '.,?!:;"()«»،؟؛“”…-'
HAMZA_FROM, HAMZA_TO = "أإآ", "ااا"


def strip_marks(text: Column) -> Column:
    """Text without diacritics, combining hamza and madda, and dagger alef."""
    return F.regexp_replace(text, f"[{MARKS}]", "")


def strip_short_marks(text: Column) -> Column:
    """Like strip_marks, but combining madda and hamza (U+0653-0655) stay."""
    return F.regexp_replace(text, "[ً-ْٰ]", "")


def strip_tashkeel_tatweel(text: Column) -> Column:
    """Text without marks and tatweel."""
    return F.regexp_replace(text, f"[{MARKS}ـ]", "")


def keep_arabic_words(text: Column) -> Column:
    """Arabic letters and short marks, words parted by single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "ـ", ""), f"[^{LETTERS}ً-ْ]+", " "))


def keep_arabic_and_punct(text: Column) -> Column:
    """Arabic letters, short marks and . , ? ! with single spaces; tatweel goes without a gap."""
    kept = F.regexp_replace(F.regexp_replace(text, "ـ", ""), f"[^{LETTERS}ً-ْ .,?!]", " ")
    return F.trim(F.regexp_replace(kept, " +", " "))


def final_clean(text: Column) -> Column:
    """Like keep_arabic_and_punct, with the braces of markers kept as well."""
    kept = F.regexp_replace(F.regexp_replace(text, "ـ", ""), f"[^{LETTERS}ً-ْ .,?!{{}}]", " ")
    return F.trim(F.regexp_replace(kept, " +", " "))


def skeleton(word: Column) -> Column:
    """Word without marks and without punctuation at its ends."""
    return F.btrim(strip_marks(word), F.lit(EDGE_PUNCT))


def trim_non_arabic(word: Column) -> Column:
    """Word without anything but Arabic letters and marks at its ends."""
    inner = f"{LETTERS_TATWEEL}{MARKS}"
    return F.regexp_replace(word, f"^[^{inner}]+|[^{inner}]+$", "")


def strip_conjunction(skel: Column) -> Column:
    """Without a leading و or ف if more than three letters are there."""
    return F.when(
        F.substring(skel, 1, 1).isin("و", "ف") & (F.length(skel) > 3), F.substring(skel, 2, 1 << 30)
    ).otherwise(skel)


def fold_hamza(text: Column) -> Column:
    """أ, إ and آ as ا."""
    return F.translate(text, HAMZA_FROM, HAMZA_TO)


def norm(word: Column) -> Column:
    """Hamza folded, final ة as ه, final ى as ي."""
    folded = fold_hamza(word)
    return F.regexp_replace(F.regexp_replace(folded, "ة$", "ه"), "ى$", "ي")


def _tail(text: Column, n: int) -> Column:
    return F.substring(text, n + 1, 1 << 30)


def variants(skel: Column) -> Column:
    """Look-up keys of a skeleton in a fixed order of priority.

    The word without its conjunction comes first, then what is left without each
    prefix (longer prefixes first), each followed by its hamza-folded form.
    """
    s = strip_conjunction(skel)
    left = [F.when(F.length(s) > 0, s)]
    for prefix in ("وال", "فال", "بال", "كال", "لل"):
        left.append(F.when(s.startswith(prefix) & (F.length(s) - len(prefix) >= 3), _tail(s, len(prefix))))
    left.append(F.when(s.startswith("ال") & (F.length(s) > 4), _tail(s, 2)))
    for letter in "وفبلك":
        left.append(F.when(s.startswith(letter) & (F.length(s) >= 4), _tail(s, 1)))
    both = [x for v in left for x in (v, fold_hamza(v))]
    return F.array_distinct(F.array_compact(F.array(*both)))


def clean_text(text: Column) -> Column:
    """Without marks, punctuation as blanks, single spaces."""
    blanks = F.translate(strip_marks(text), EDGE_PUNCT, " " * len(EDGE_PUNCT))
    return F.trim(F.regexp_replace(blanks, r"(?U)\s+", " "))


def phrase_count(clean: Column, phrase: str, allow_prefix: bool = True) -> Column:
    """Occurrences of a phrase in cleaned text, at word borders, with an optional و or ف before it.

    The border after a match is looked at, not taken, so adjacent repeats count.
    """
    words = phrase.split()
    lead = "[وف]?" if allow_prefix else ""
    pattern = r"(?:^|\s)" + lead + r"\s+".join(_quoted(w) for w in words) + r"(?=\s|$)"
    return F.regexp_count(clean, F.lit(pattern))


def _quoted(word: str) -> str:
    return "\\Q" + word.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def convert_punctuation(text: Column) -> Column:
    """Arabic comma and question mark as , and ?."""
    return F.translate(text, "،؟", ",?")


def marks_per_letter(text: Column) -> Column:
    """Diacritics for each Arabic letter; texts without letters count as one letter."""
    marks = F.regexp_count(text, F.lit("[ً-ْ]"))
    return marks / F.greatest(F.regexp_count(text, F.lit(f"[{LETTERS}]")), F.lit(1))


def marks_per_word(text: Column) -> Column:
    """Marks for each word that has an Arabic letter."""
    arabic = F.size(F.filter(words(text), lambda w: w.rlike(f"[{LETTERS_TATWEEL}]")))
    return F.regexp_count(text, F.lit(f"[{MARKS}]")) / F.greatest(arabic, F.lit(1))


def words(text: Column) -> Column:
    """Words between white space; no empty ones."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def first_difference(a: Column, b: Column) -> Column:
    """Position of the first character that differs, -1 if there is none."""
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    same = F.zip_with(chars(a), chars(b), lambda x, y: x.eqNullSafe(y))
    at = F.array_position(same, False)
    return F.when(at == 0, F.lit(-1)).otherwise(at - 1).cast("int")


def word_at(text: Column, position: Column) -> Column:
    """The space-separated word that covers a character position."""
    before = F.substring_index(text.substr(F.lit(1), position), " ", -1)
    after = F.substring_index(text.substr(position + 1, F.lit(1 << 30)), " ", 1)
    return F.concat(before, after)


def source_prefix(unit: Column) -> Column:
    """speaker_row prefix of a unit id, null where there is none."""
    return F.nullif(F.regexp_extract(unit, r"^([a-z]+_\d+)_", 1), F.lit(""))


def text_shape(text: Column) -> Column:
    """Flags: has an ASCII letter, has a digit, has Arabic speech."""
    return F.struct(
        text.rlike("[A-Za-z]").alias("latin"),
        text.rlike(r"(?U)\d").alias("digit"),
        text.rlike(f"[{LETTERS}]").alias("arabic"),
    )


def reason_key(reason: Column) -> Column:
    """A reason before its first parenthesis, at most 60 characters."""
    return F.substring(F.trim(F.substring_index(reason, "(", 1)), 1, 60)


def char_action(char: Column) -> Column:
    """What happens to a character that is no letter: converted, stripped or kept."""
    return (
        F.when(char.isin("،", "؟"), "convert")
        .when(char.rlike(f"[{MARKS}]"), "mark")
        .when(char.isin(".", ",", "?", "!"), "token")
        .otherwise("keep")
    )


def units(word: Column) -> Column:
    """A word's letters with their marks, as strings of one letter and what it carries."""
    return F.regexp_extract_all(word, F.lit(f"[{LETTERS}][{MARKS}]*"), F.lit(0))


def compare_words(a: Column, b: Column) -> Column:
    """exact, final_only (only the last letter's marks differ), internal or skeleton."""
    ua, ub = units(a), units(b)
    n = F.size(ua)
    differ = F.filter(
        F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.when(F.get(ua, i - 1) != F.get(ub, i - 1), i)),
        lambda i: i.isNotNull(),
    )
    return (
        F.when(a == b, "exact")
        .when((strip_marks(a) != strip_marks(b)) | (n != F.size(ub)), "skeleton")
        .when(F.size(differ) == 0, "exact")
        .when((F.size(differ) == 1) & (F.get(differ, F.lit(0)) == n), "final_only")
        .otherwise("internal")
    )


def word_final_mask(text: Column) -> Column:
    """For every base letter of a text: is it the last of its word?"""
    per_word = F.transform(
        words(text),
        lambda w: F.transform(
            units(w), lambda u, i: F.struct(F.substring(u, 1, 1).alias("letter"), (i == F.size(units(w)) - 1).alias("final"))
        ),
    )
    return F.flatten(per_word)


def definite(form: Column) -> Column:
    """A vocalised form with the article, unless it has one."""
    has = strip_marks(form).startswith("ال")
    return F.when(has, form).otherwise(F.concat(F.lit("اِلْ"), form))


def definite_spaced(form: Column) -> Column:
    """definite() for every word of a form."""
    return F.array_join(F.transform(words(form), definite), " ")


# Pronouns that a stem may carry; stems by name with what a candidate is and which candidates are the stem itself.
_PRONOUNS = "ه|ها|ك|كي|كم|هم|هن|نا|ي|يه|يها"
STEMS = {
    "دين": ("^دين", f"^دين(?:{_PRONOUNS})?$"),
    "حساب": ("^حساب", f"^حساب(?:{_PRONOUNS})?$|^حسابات"),
    "نار": ("^نار", f"^نار(?:{_PRONOUNS})?$"),
    "بركة": ("^برك", "^بركه|^بركات"),
    "عقاب": ("^عقاب", f"^عقاب(?:{_PRONOUNS})?$"),
    "عقبة": ("^عقب", "^عقبه"),
    "وحي": ("^وحي", f"^وحي(?:{_PRONOUNS})?$"),
    "آخرة": ("اخره", "اخره"),
    "نبي": ("نبي", "نبي"),
    "قضاء": ("^قضاء", f"^قضاء(?:.(?:{_PRONOUNS}))?$"),
    "قدر": ("^قدر", f"^قدر(?:{_PRONOUNS})?$"),
    "رب": ("^رب", "^(?:رب|ربي)$|^ربنا"),
    "صلاة": ("^صلا", "^صلا"),
}


def stem_candidates(key: Column) -> Column:
    """Every stem that a folded key is a candidate of: array of (stem, genuine)."""
    each = F.array(
        *(
            F.when(key.rlike(near), F.struct(F.lit(name).alias("stem"), key.rlike(true).alias("genuine")))
            for name, (near, true) in STEMS.items()
        )
    )
    return F.array_compact(each)


def valid_list_form(form: Column) -> Column:
    """Whether a form may enter a list: Arabic letters, marks and single spaces, and letters that remain without marks."""
    return F.coalesce(
        form.rlike("^[\u0621-\u0655\u0670 ]+$") & (skeleton(form) != "") & ~form.contains("  "), F.lit(False)
    )


def decision_trace(word: Column) -> Column:
    """Every step from a word to its look-up keys."""
    skel = skeleton(word)
    return F.struct(
        word.alias("word"),
        strip_marks(word).alias("bare"),
        skel.alias("skeleton"),
        strip_conjunction(skel).alias("stem"),
        fold_hamza(skel).alias("folded"),
        norm(skel).alias("normal"),
        variants(skel).alias("keys"),
    )
