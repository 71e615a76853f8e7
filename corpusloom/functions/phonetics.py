"""Arabic script to Buckwalter letters, phones, tokens and ids, and the policy for one letter.

Everything that maps words to words is a Column expression. The left-to-right
reading of a vocalised word is one regular expression whose alternatives look at
their neighbours; it runs in a Python worker, once for each distinct word if the
caller deduplicates words first.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# The two alphabets, position by position.
ARABIC = "بذطمترظنثزعهجسغحقفخصشدضكأءئؤإآاىةيلوًٌٍَُِّْ"
BUCKWALTER = "b*TmtrZn^zEhjsgHqfxS$dDk>'}&<|AYpylwFNKaui~o"

#: The token inventory; a token's id is its place.
SYMBOLS = (
    "_pad_ _eos_ _sil_ _dbl_ _+_ . , ? ! < b t ^ j H x d * r z s $ S D T Z E g f q k l m n h w y v a u i aa uu ii"
).split()

#: Consonants whose phone is not the letter itself.
_HAMZA = ">'}&<"
_CONSONANT = "><}&'bt^jHxd*rzs$SDTZEgfqkmnh"
#: Rewrites of an utterance before it is read, in this order.
_PREPARE = (
    ("AF", "F"), ("ـ", ""), ("o", ""), ("aA", "A"), ("aY", "Y"), (" A", " "), ("F", "an"), ("N", "un"), ("K", "in"),
    (r"\|", ">A"), ("i~", "~i"), ("a~", "~a"), ("u~", "~u"), ("Ai", "<i"), ("Aa", ">a"), ("Au", ">u"),
    ("^>([^auAw])", r">a\1"), (" >([^auAw ])", r" >a\1"), ("<([^i])", r"<i\1"), (r"(\S)([.?,!])", r"\1 \2"),
)
#: Irregular words by their bare letters; the reading that ends like the word is taken.
_IRREGULAR = {
    "h*A": ("h aa * aa", "h aa * a"),
    "h*h": ("h aa * i h i", "h aa * i h"),
    "h*An": ("h aa * aa n i", "h aa * aa n"),
    "h&lA'": ("h aa < u l aa < i", "h aa < u l aa <"),
    "*lk": ("* aa l i k a", "* aa l i k"),
    "k*lk": ("k a * aa l i k a", "k a * aa l i k"),
    "*lkm": "* aa l i k u m",
    ">wl}k": ("< u l aa < i k a", "< u l aa < i k"),
    "Th": "T aa h a",
    "lkn": ("l aa k i nn a", "l aa k i n"),
    "lknh": "l aa k i nn a h u",
    "lknhm": "l aa k i nn a h u m",
    "lknk": ("l aa k i nn a k a", "l aa k i nn a k i"),
    "lknkm": "l aa k i nn a k u m",
    "lknkmA": "l aa k i nn a k u m aa",
    "lknnA": "l aa k i nn a n aa",
    "AlrHmn": ("rr a H m aa n i", "rr a H m aa n"),
    "Allh": ("ll aa h i", "ll aa h", "ll aa h u", "ll aa h a"),
    "h*yn": ("h aa * a y n i", "h aa * a y n"),
    "nt": "n i t",
    "fydyw": "v i d y uu",
    "lndn": "l a n d u n",
}
_IRREGULAR_LETTERS = re.compile("[^h*An'>wl}kmyTtfd]")

_SHORT, _MARK = "aiuoFNK", "aiuoFNK~"
_LETTER = re.compile(
    rf"""
      (?P<sun>   l(?=[^{_MARK}AYwy]~))                                  # assimilated article
    | (?P<cons>  [{_CONSONANT}l]) (?P<twice>~?)
    | (?P<taa>   p) (?=(?P<open>[{_MARK}])?)
    | (?P<short> [aui])
    | (?P<first> (?<=^[wk])A)                                           # after a one-letter prefix
    | (?P<mute>  (?<=[ui])A)
    | (?P<alef>  [AY])
    | (?P<glide> (?:(?<=u)w(?![aiAY])|(?<=i)y(?![auAY])) (?=[{_SHORT}AY]|[wy](?![{_MARK}Awy])|[{_CONSONANT}l|]|$))
    | (?P<semi>  [wy] (?=[{_SHORT}AY]|[wy](?![{_MARK}Awy])) | (?<=[{_SHORT}])[wy](?=[{_CONSONANT}l|]|$))
    | (?P<pair>  (?:(?<=a)[wy]|(?<=[iy])w|(?<=[wu])y)~)
    | (?P<half>  [wy]~)
    | (?P<long>  [wy])
    """,
    re.VERBOSE,
)
_LONG = {"w": "uu", "y": "ii"}


def read_word(word: str) -> list[str]:
    """Phones of a vocalised word in Buckwalter letters."""
    found = _IRREGULAR.get(_IRREGULAR_LETTERS.sub("", word))
    if isinstance(found, str):
        return found.split()
    if found:
        last = word[-1]
        end = {"A": "aa"}.get(last, "<" if last in _HAMZA else last)
        for reading in found:
            if reading.split()[-1] == end:
                return reading.split()
    phones: list[str] = []
    for m in _LETTER.finditer(word):
        kind, text = m.lastgroup, m.group()
        if m["cons"]:
            phone = "<" if m["cons"] in _HAMZA else m["cons"]
            phones.append(phone * (2 if m["twice"] else 1))
        elif m["taa"]:
            phones += ["t"] if m["open"] else []
        elif kind in ("short", "semi"):
            phones.append(text)
        elif kind == "first":
            phones.append("a")
        elif kind == "alef":
            phones.append("aa")
        elif kind in ("glide", "long"):
            phones.append(_LONG[text])
        elif kind == "pair":
            phones += [text[0], text[0]]
        elif kind == "half":
            phones += [_LONG[text[0]], text[0]]
    return _settle(phones)


def _settle(phones: list[str]) -> list[str]:
    """A long vowel swallows the short one before it; equal short vowels are one; two glides are one doubled."""
    out: list[str] = []
    before = ""
    for p in phones:
        if out and (p in ("aa", "uu", "ii") and before == p[0] or p in ("u", "i") and before == p):
            out[-1] = p
        elif out and p in ("y", "w") and before == p:
            out[-1] += p
        else:
            out.append(p)
        before = p
    return out


def read_utterance(buckwalter: str) -> list[str]:
    """Tokens of an utterance: phones, word separators, punctuation, a last separator and the end."""
    for pattern, new in _PREPARE:
        buckwalter = re.sub(pattern, new, buckwalter)
    words: list[list[str]] = []
    for word in buckwalter.split(" "):
        if word in ("-", "sil"):
            words.append([])
        elif word in (".", ",", "?", "!"):
            if words:
                words[-1].append(word)
            else:
                words.append([word])
        else:
            words.append(read_word(word))
    tokens: list[str] = []
    for i, phones in enumerate(words):
        tokens += ["_+_"] if i else []
        for p in phones:
            doubled = len(p) == 2 and p[0] == p[1] and p not in ("aa", "uu", "ii")
            tokens += [p[0], "_dbl_"] if doubled else [p]
    return [*tokens, "_+_", "_eos_"]


@F.pandas_udf(ArrayType(StringType()))
def phone_tokens(utterances: pd.Series) -> pd.Series:
    """read_utterance over a column."""
    return utterances.map(lambda u: None if u is None else read_utterance(u))


def to_buckwalter(text: Column) -> Column:
    return F.translate(text, ARABIC, BUCKWALTER)


def from_buckwalter(text: Column) -> Column:
    return F.translate(text, BUCKWALTER, ARABIC)


def token_ids(tokens: Column) -> Column:
    """Ids of tokens; an unknown token is null."""
    at = F.create_map(*(x for i, t in enumerate(SYMBOLS) for x in (F.lit(t), F.lit(i))))
    return F.transform(tokens, lambda t: F.try_element_at(at, t))


def ids_tokens(ids: Column) -> Column:
    names = F.array(*(F.lit(t) for t in SYMBOLS))
    return F.transform(ids, lambda i: F.get(names, i))


def egyptian_sounds(tokens: Column) -> Column:
    """j, ^ and * as the spoken dialect says them: v, t and d."""
    return F.transform(tokens, lambda t: F.when(t == "j", "v").when(t == "^", "t").when(t == "*", "d").otherwise(t))


# Skeletons of the words that keep the letter q, and of those that say g.
KEEP_Q = (
    "AlAnqsAm AlHqyqp AlHqyqy AlHqyqyp Al^qAfAt Al^qAfp Al^qAfy Al^qAfyp AlmnTq AlmnTqy AlmnTqyp Almstqym Almstqymp "
    "AlqAbD AlqAnwn AlqAnwny AlqAnwnyp AlqSS AlqSSy AlqSp AlqT AlqTAE AlqTE AlqTEp Alqdws AlqhAr Alqr|n Alqsmp "
    "AlqwAnyn Alqywm Altqryb AnqsAm Hqyqp Hqyqy Hqyqyp ^qAfAt ^qAfp ^qAftnA ^qAfy ^qAfyp bAlHqyqp bAlmnTq bAlqSS "
    "bAlqSp bAlqTE bHqyqp bmnTq bmnTqyp bqTEp bqwAnynh btqrybA btqwY fAlqSp fqT kqTE l^qAfp llqSp llqTEp lqSS lqSp "
    "lqTAE mnTq mnTqy mnTqyp mstqym mstqymp qAnwn qAnwny qAnwnyA qAnwnyp qSS qSp qT qTAE qTE qTEp qTEtyn qTb qTk "
    "qry$ qr|n qsmp qwAnyn qwAnynh qwAnynhA tqryb tqrybA tqryby tqwY wAlHqyqp wAl^qAfp wAlmnTqy wHqyqy w^qAfp wmnTqy "
    "wmnTqyp wqAbD wqSp"
).split()
SAY_G = (
    ">rqAm Al>rqAm AlArqAm AlmqAl AlmqAlAt AlmqAm Alrqm bAl>rqAm bAlrqm brqm krqm l>rqAm lrqm mqAl mqAlAt mqAm qnTAr "
    "qr$ qr$yn qyrAT rqm wrqm"
).split()
#: What a marker in braces asks for.
MARKER_ACTION = {"ق": "q", "q": "q", "ء": "h", "أ": "h", "h": "h", "ج": "g", "گ": "g", "g": "g"}


def skeleton_keys(skel: Column) -> Column:
    """Keys under which a Buckwalter skeleton is looked up: without article and one clitic, with final h as p, without final A."""
    tail = lambda n: F.substring(skel, n + 1, 1 << 30)
    forms = [skel, F.when(skel.startswith("Al") & (F.length(skel) > 3), tail(2))]
    for c in "wfblk":
        forms.append(F.when(skel.startswith(c) & (F.length(skel) > 2), tail(1)))
        forms.append(F.when(skel.startswith(f"{c}Al") & (F.length(skel) > 4), tail(3)))
    base = F.array_compact(F.array(*forms))
    swap = lambda a, end, new: F.transform(
        F.filter(a, lambda v: v.endswith(end) & (F.length(v) > 2)), lambda v: F.concat(F.substring(v, F.lit(1), F.length(v) - 1), F.lit(new))
    )
    taa = F.array_union(base, swap(base, "h", "p"))
    return F.array_distinct(F.array_union(taa, swap(taa, "A", "")))


def bare_skeleton(word: Column) -> Column:
    """A Buckwalter word without vowel marks and punctuation."""
    return F.regexp_replace(word, "[auiFNK~o.,!?;:\"'،؛…()—-]", "")


def _has(keys: Column, values: list[str]) -> Column:
    return F.arrays_overlap(keys, F.array(*(F.lit(v) for v in values)))


def say_q(word: Column, actions: Column, dialect: str = "egy") -> Column:
    """A Buckwalter word with its q as spoken: kept, j for g, or a hamza.

    actions: map from skeleton to q, g or h, from markers in the text. The order
    is: progressive verbs, marker, words that keep q, words that say g, hamza. In
    standard speech only markers change the letter.
    """
    skel = bare_skeleton(word)
    keys = skeleton_keys(skel)
    asked = F.get(F.filter(F.transform(keys, lambda k: F.try_element_at(actions, k)), lambda a: a.isNotNull()), F.lit(0))
    hamza = F.replace(F.replace(word, F.lit("q~"), F.lit("<")), F.lit("q"), F.lit("<"))
    g = F.replace(word, F.lit("q"), F.lit("j"))
    out = F.when(~word.contains("q"), word)
    if dialect == "egy":
        out = out.when(skel.rlike("^[wf]?b(?:yt|y|t)?qr>"), hamza)
    out = out.when(asked == "q", word).when(asked == "g", g).when(asked == "h", hamza)
    if dialect != "egy":
        return out.otherwise(word)
    return out.when(_has(keys, KEEP_Q), word).when(_has(keys, SAY_G), g).otherwise(hamza)


def marker_actions(text: Column) -> Column:
    """Map from each key of a marked word to what its marker asks for; the last marker of a key wins."""
    pattern = r"([ء-غف-ي][ء-غف-يً-ْ]*)\s*\{([^{}]{1,2})\}"
    pairs = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("word"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("marker"),
    )
    known = F.create_map(*(F.lit(x) for kv in MARKER_ACTION.items() for x in kv))

    def entries(p: Column) -> Column:
        letters = F.split(p["marker"], "")
        action = F.get(F.filter(F.transform(letters, lambda c: F.try_element_at(known, c)), lambda a: a.isNotNull()), F.lit(0))
        skel = F.regexp_replace(bare_skeleton(to_buckwalter(p["word"])), "(?<=..)h$", "p")
        keep = p["word"].contains("ق") & action.isNotNull()
        return F.when(keep, F.transform(skeleton_keys(skel), lambda k: F.struct(k.alias("k"), action.alias("v")))).otherwise(
            F.array().cast("array<struct<k:string,v:string>>")
        )

    flat = F.flatten(F.transform(pairs, entries))
    # Of equal keys the last one stays.
    last = F.filter(flat, lambda e, i: ~F.exists(F.slice(flat, i + 2, F.size(flat) + 1), lambda o: o["k"] == e["k"]))
    return F.when(F.size(flat) > 0, F.map_from_entries(last)).otherwise(F.create_map().cast("map<string,string>"))


def without_markers(text: Column) -> Column:
    """Text without markers, single spaces, no space before punctuation."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, r"\{[^{}]{1,2}\}", " "), r"(?U)\s+", " "))
    return F.regexp_replace(bare, r"\s+([،؛,.!؟:…]+)", "$1")


def prepare_buckwalter(text: Column, dialect: str = "egy") -> Column:
    """Markers applied, mark order settled, Buckwalter letters, q as spoken."""
    from corpusloom.functions.punctuation import normalize_mark_order

    words = F.split(to_buckwalter(normalize_mark_order(without_markers(text))), " ", -1)
    actions = marker_actions(text)
    return F.array_join(F.transform(words, lambda w: say_q(w, actions, dialect)), " ")


def with_tokens(df: DataFrame, text: str, dialect: str = "egy", out: str = "tokens") -> DataFrame:
    """df with the tokens of a text column in either dialect.

    The prepared text passes through a one-element explode: it reaches the Python
    worker as a plain column, whatever lambdas it is made of.
    """
    ready = F.explode(F.array(prepare_buckwalter(F.col(text), dialect)))
    read = df.select("*", ready.alias("__ready")).withColumn(out, phone_tokens("__ready")).drop("__ready")
    return read.withColumn(out, egyptian_sounds(F.col(out))) if dialect == "egy" else read


def count_tokens(n: Column, density: Column) -> Column:
    """Expected tokens of a text: half as many again if it is hardly vocalised."""
    return F.when(density < 0.30, F.bround(n * 1.5)).otherwise(n).cast("int")


def q_environment(word: Column) -> Column:
    """How the first ق of a vocalised word is followed."""
    after = F.regexp_extract(word, "ق[ّ]?(.?)", 1)
    return (
        F.when(~word.contains("ق"), "none")
        .when(after.isin("َ", "ُ", "ا", "و"), "deep")
        .when(after.isin("ِ", "ي"), "plain")
        .when(after == "ْ", "sukun")
        .when(after == "", "end")
        .when(after.rlike("[ء-ي]"), "bare")
        .otherwise("other")
    )


def q_class(skel: Column) -> Column:
    """Class of a Buckwalter skeleton without markers: g, q or hamza."""
    keys = skeleton_keys(skel)
    return F.when(_has(keys, SAY_G), "g").when(_has(keys, KEEP_Q), "q").otherwise("hamza")
