"""Personal data by weak supervision.

Patterns propose candidate spans, many of which are none of the kind: ordinary
capitals beside names, dates and versions beside telephone numbers, part numbers
beside accounts. Regex, checksum, gazetteer, context and surroundings labelers
vote on each one (yes, no, abstain). The votes of the whole corpus are counted by
pattern; expectation-maximisation estimates for every kind how often each labeler
says what of true and of false candidates; its posterior trains a logistic span
classifier over votes and span features. Spans of the four base kinds are always
reported; the classifier decides on the rest.

The counts are exact and cover every candidate. Only they reach the driver: a
pattern is a kind, a vote of each labeler and a few binary features, so their
number is bounded by a product of constants and not by the corpus.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.storage import materialize
from corpusloom.llm.worker import task

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("person", "address", "mail_words", "phone_local", "national_id", "iban")
KINDS = BASE_KINDS + ADDED_KINDS

# The base patterns.
_AT_RIGHT = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LEFT_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match of these begins at the start of a run of digits, so the look-behind
# changes no match; it keeps a failed run from being tried from every digit.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Gazetteers: common first names of several languages, titles, streets, suffixes of domains,
# and capitalised words that are no names.
_TITLES = frozenset("Mr Mrs Ms Miss Dr Prof Sir Lady Herr Frau Monsieur Madame Mme Mlle Señor Señora Sr Sra Don Doña".split())
_NAMES = frozenset(
    (
        "Adam Agnes Alan Albert Alexander Alice Amelia Amy Andrea Andreas Andrew Angela Anna Anne Anthony Antonio "
        "Barbara Beatrice Benjamin Bernard Brian Bruno Camille Carla Carlos Carmen Carol Caroline Catherine Cecilia "
        "Charles Charlotte Chloé Christian Christine Claire Clara Claude Claudia Daniel David Deborah Diana Diego "
        "Dieter Dominique Donald Donna Dorothy Edward Elena Elisabeth Elizabeth Emily Emma Eric Erik Eva Felix Fernando "
        "Florian Francisco Frank Franz François Frédéric Gabriel George Gerhard Gisela Grace Greta Guillaume Hannah Hans "
        "Heidi Heinrich Helen Helga Henri Henry Hugo Inés Isabel Jack Jacques James Jane Javier Jean Jennifer Jessica "
        "Joan Johann John Jorge José Joseph Juan Julia Julie Jürgen Karen Karl Katharina Kevin Klaus Laura Lena Leon "
        "Linda Lisa Louis Louise Luc Lucas Lucía Luis Manuel Marc Margaret Maria Marie Mario Mark Markus Marta Martin "
        "Mary Matthew Michael Michel Miguel Monika Nancy Nathalie Nicole Olivia Oscar Pablo Patricia Paul Pedro Peter "
        "Philip Pierre Rachel Raúl Richard Robert Roland Sabine Sandra Sarah Simon Sofia Sophie Stefan Susan Teresa Thomas "
        "Ursula Walter William Wolfgang"
    ).split()
)
_NO_NAMES = frozenset(
    (
        "The This That These Those And But For With From Not All New North South East West United Apache License Version "
        "Public Copyright University Institute College School Bank Street Road Avenue Park City River Lake Mount County "
        "State National International General Central Royal Inc Ltd Corp Company Group Press Software Foundation Project "
        "Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August "
        "September October November December Chapter Section Figure Table Part Page Appendix Act"
    ).split()
)
_STREETS = frozenset(
    "Street St Road Rd Avenue Ave Lane Ln Drive Dr Boulevard Blvd Court Ct Square Sq Terrace Place Way Close Crescent "
    "Straße Strasse Weg Platz Allee Gasse Ufer Ring Rue Quai Calle Plaza Paseo Camino".split()
)
_DOMAINS = frozenset("com org net edu gov mil int io co de fr es it nl be ch at uk us ca eu info biz dev app me".split())
# Lengths of account numbers by country.
_IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27,
    "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24,
}

_UPPER, _LOWER = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿ"
_CAP = rf"[{_UPPER}][{_LOWER}]+(?:['-][{_UPPER}]?[{_LOWER}]+)*+"
#: Words that introduce a name or open a sentence and are no part of it.
_CUES = "Contact|Call|Dear|From|Name|Named|Write|Ask|Meet|Patient|The|This|That|And|But|For|With|In|On|At|To|Of"
_ADDED = {
    "person": re.compile(
        rf"(?<![{_UPPER}{_LOWER}'-])(?!(?:{_CUES})\b)(?:(?:{'|'.join(sorted(_TITLES))})\.?\x20{_CAP}(?:\x20{_CAP}){{0,2}}|{_CAP}(?:\x20{_CAP}){{1,2}})(?![{_UPPER}{_LOWER}])"
    ),
    "address": re.compile(rf"(?<![0-9A-Za-z.,-])[0-9]+[a-z]?\x20{_CAP}(?:\x20{_CAP}){{0,3}}"),
    "mail_words": re.compile(
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20at\x20|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]++(?:(?:\x20dot\x20|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)+(?![A-Za-z0-9])"
    ),
    "phone_local": re.compile(r"(?<![0-9A-Za-z.])(?![0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))(?:\([0-9]{2,5}\)\x20?|[0-9]{2,5}[\x20./-])[0-9]{2,4}(?:[\x20./-][0-9]{2,4}){1,3}(?![0-9A-Za-z])"),
    "national_id": re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
}
_NEEDS_DIGIT = {"address", "phone_local", "national_id", "iban"}
_NEEDS_WORD = {"mail_words": ("at ", "(at)", "[at]")}
_TWO_CAPS = re.compile(rf"[{_LOWER}.]\x20[{_UPPER}][{_LOWER}]")

_CUE = {
    "mail": r"e-?mail|mail|contact|write|reach|kontakt|correo|courriel",
    "number": r"phone|tel|telephone|mobile|cell|fax|call|ring|dial|kontakt|teléfono|téléphone|telefon",
    "person": r"name|named|contact|patient|resident|signed|dear|call|ask|met|author|written\x20by|born|nom|nombre",
    "place": r"lives?|address|resident|visit|office|ship|deliver|wohnt|adresse|dirección|habite|at",
    "id": r"ssn|social|security|id|identity|passport|taxpayer|insurance",
    "money": r"account|iban|bank|transfer|pay|card|visa|konto|cuenta|compte",
    "host": r"ip|host|login|server|address|client|from",
}
_CUE_OF = {
    "email": "mail", "ip": "host", "card": "money", "phone": "number", "person": "person", "address": "place",
    "mail_words": "mail", "phone_local": "number", "national_id": "id", "iban": "money",
}
_FOR = {k: re.compile(rf"(?i)\b(?:{_CUE[c]})\b") for k, c in _CUE_OF.items()}
_AGAINST = re.compile(
    r"(?i)\b(?:version|release|isbn|issn|issue|order|page|pages|chapter|example|section|build|port|price|invoice|item|dummy|test|"
    r"part|serial|model|catalogue|article|date|dated|on|since|until|room|figure|table|ticket|code|sku)\b"
)
_DATE = re.compile(r"(?:[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4})\Z")
#: Characters left of a span that the context labelers read.
CONTEXT = 40

#: Labelers in the order of their votes.
LABELERS = ("shape", "checksum", "gazetteer", "context", "counter_context", "surroundings")
FEATURES = ("left_edge", "right_edge", "long", "digits")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _iban_ok(text: str) -> bool:
    s = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping e-mail spans, in time linear in the text."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        left = at
        while left > done and text[left - 1] in _LEFT_CHARS:
            left -= 1
        if left < at and (m := _AT_RIGHT.match(text, at + 1)):
            done = m.end()
            out.append((left, done))
        else:
            # What stands left of a lone sign cannot be reached from a later one.
            done = max(done, at + 1)
        at = text.find("@", done)
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the four base kinds, offsets in code points."""
    found = {k: [] for k in BASE_KINDS}
    if "@" in text:
        found["email"] = emails(text)
    if _DIGIT.search(text):
        found["ip"] = [
            m.span()
            for m in _IP.finditer(text)
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))
        ]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m.group().replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and _luhn(digits):
                    found["card"].append(m.span())
        if "+" in text:
            found["phone"] = [
                m.span() for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15
            ]
    return found


def _votes(kind: str, text: str, start: int, end: int) -> tuple[int, ...]:
    """A vote of each labeler: 1 yes, 0 abstains, -1 no."""
    span = text[start:end]
    before = text[max(0, start - CONTEXT) : start]
    left, right = text[max(0, start - 2) : start], text[end : end + 2]
    digits = sum(c.isdigit() for c in span)
    shape = checksum = gazetteer = surroundings = 0
    if kind in ("email", "mail_words"):
        tail = re.split(r"[^A-Za-z0-9]+", span)[-1].lower()
        shape = 1 if "(" in span or "[" in span else 0
        if kind == "email":
            shape = 1 if tail.isalpha() and 2 <= len(tail) <= 10 else -1
        gazetteer = 1 if tail in _DOMAINS else -1
    elif kind == "ip":
        shape = 1 if all(p == "0" or not p.startswith("0") for p in span.split(".")) else -1
        checksum = -1 if span.startswith(("0.", "255.")) or span.endswith(".0") else 1
        surroundings = -1 if left[-1:] in ("v", "V", "-", ".") or right[:1] == "-" else 0
    elif kind == "card":
        shape = 1 if re.fullmatch(r"[0-9]{16,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3}(?:[\x20-]?[0-9]{1,3})?", span) else -1
        checksum = 1 if span[0] in "3456" else -1
    elif kind in ("phone", "phone_local"):
        shape = 1 if "(" in span or kind == "phone" else -1 if _DATE.match(span) else 0
        checksum = 1 if 9 <= digits <= 13 else -1
        surroundings = -1 if left[-1:] in tuple("$€£#.,/-") or right[:1] in tuple("%$€£/") else 0
    elif kind == "person":
        words = span.replace(".", "").split(" ")
        shape = 1 if words[0] in _TITLES else 0
        if words[0] in _TITLES:
            words = words[1:]
        gazetteer = -1 if any(w in _NO_NAMES for w in words) else 1 if words[0] in _NAMES else 0
        # A capital at the start of a sentence tells nothing, which here speaks against a name.
        surroundings = 0 if left[:1].isalnum() and left[1:] == " " or left == ", " else -1
    elif kind == "address":
        words = span.split(" ")
        shape = 1 if len(words[0].rstrip("abcdefgh")) <= 4 and len(words) > 2 else -1
        gazetteer = 1 if words[-1] in _STREETS or words[-1].lower().endswith(("straße", "strasse", "weg", "platz", "gasse")) or words[1] in ("Rue", "Calle") else -1
        surroundings = 1 if right[:1] in (",", "\n") else -1 if left[-1:] in tuple("$€£#%") else 0
    elif kind == "national_id":
        shape = 1
        checksum = -1 if span[:3] in ("000", "666") or span[0] == "9" or span[4:6] == "00" or span[7:] == "0000" else 1
        surroundings = -1 if left[-1:] in tuple("#/$") else 0
    elif kind == "iban":
        known = _IBAN_LENGTHS.get(span[:2])
        gazetteer = 1 if known else -1
        shape = 1 if known == len(span.replace(" ", "")) else -1
        checksum = 1 if _iban_ok(span) else -1
        surroundings = -1 if left[-1:] in tuple("#/-") else 0
    context = 1 if _FOR[kind].search(before) else 0
    counter = -1 if _AGAINST.search(before) else 0
    return shape, checksum, gazetteer, context, counter, surroundings


def _features(text: str, start: int, end: int) -> tuple[int, ...]:
    left = start == 0 or not text[start - 1].isalnum()
    right = end == len(text) or not text[end].isalnum()
    digits = sum(c.isdigit() for c in text[start:end])
    return int(left), int(right), int(end - start > 16), int(2 * digits > end - start)


def encode(kind: str, votes: tuple[int, ...], features: tuple[int, ...]) -> int:
    code = KINDS.index(kind)
    for v in votes:
        code = code * 3 + v + 1
    for f in features:
        code = code * 2 + f
    return code


def decode(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind numbers, votes and features of pattern codes."""
    code = np.asarray(code, np.int64).copy()
    feats, votes = [], []
    for _ in FEATURES:
        feats.append(code % 2)
        code //= 2
    for _ in LABELERS:
        votes.append(code % 3 - 1)
        code //= 3
    return code, np.stack(votes[::-1], 1), np.stack(feats[::-1], 1)


def candidates(text: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int, int]]:
    """Spans of the added kinds that touch no base span and no earlier candidate."""
    taken = sorted(s for spans in base.values() for s in spans)
    out: list[tuple[str, int, int]] = []
    has_digit = bool(_DIGIT.search(text))
    for kind, pattern in _ADDED.items():
        if kind in _NEEDS_DIGIT and not has_digit:
            continue
        if kind in _NEEDS_WORD and not any(w in text for w in _NEEDS_WORD[kind]):
            continue
        if kind == "person" and not _TWO_CAPS.search(text):
            continue
        out += [(kind, *m.span()) for m in pattern.finditer(text)]
    if not out:
        return out
    kept, busy = [], taken
    starts = np.array([s for s, _ in busy], np.int64)
    ends = np.maximum.accumulate(np.array([e for _, e in busy], np.int64)) if busy else starts
    last = -1
    for kind, s, e in sorted(out, key=lambda x: (x[1], -x[2], KINDS.index(x[0]))):
        i = int(np.searchsorted(starts, e, "left"))
        if s >= last and not (i and ends[i - 1] > s):
            kept.append((kind, s, e))
            last = e
    return kept


_SCAN = (
    "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, "
    "base_codes array<int>, found array<struct<kind:int,start:int,stop:int,code:int>>"
)


@task("pii")
def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    item = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("code", pa.int32())])
    for batch in batches:
        rows = []
        for text in batch.column(1):
            text = text.as_py() or ""
            base = base_spans(text)
            joined = ",".join(f"{k}:{s}:{e}" for k in BASE_KINDS for s, e in base[k])
            codes = [encode(k, _votes(k, text, s, e), _features(text, s, e)) for k in BASE_KINDS for s, e in base[k]]
            found = [
                {"kind": KINDS.index(k), "start": s, "stop": e, "code": encode(k, _votes(k, text, s, e), _features(text, s, e))}
                for k, s, e in candidates(text, base)
            ]
            rows.append((*(len(base[k]) for k in BASE_KINDS), hashlib.sha256(joined.encode()).hexdigest(), joined, codes, found))
        cols = list(zip(*rows)) if rows else [[]] * 8
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).cast(pa.int64()),
                *(pa.array(cols[i], pa.int64()) for i in range(4)),
                pa.array(cols[4], pa.string()),
                pa.array(cols[5], pa.string()),
                pa.array(cols[6], pa.list_(pa.int32())),
                pa.array(cols[7], pa.list_(item)),
            ],
            names=["id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "base_codes", "found"],
        )


#: What a labeler is held to say before anything is counted: votes of no, abstention, yes of false and of true candidates.
_START = np.array([[1.5, 1.0, 0.5], [0.5, 1.0, 1.5]])
#: How many candidates the estimate over all kinds counts for in that of one kind.
POOLED = 3.0


def estimate_reliability(
    votes: np.ndarray, n: np.ndarray, rounds: int = 80, prior: np.ndarray | None = None, share: float = 0.5
) -> tuple[np.ndarray, np.ndarray, float]:
    """EM for labelers that are independent given the truth.

    votes: pattern by labeler in -1, 0, 1; n: how often each pattern occurs;
    prior: counts [truth, labeler, vote] that are added to those of the corpus. A
    pattern without a yes is none: nothing but a yes can say what the truth is.
    Returns the probability that a pattern is personal data, the vote
    distributions [truth, labeler, vote], and the share of personal data.
    """
    one_hot = (votes[:, :, None] == np.array([-1, 0, 1])).astype(float)
    prior = np.repeat(_START[:, None, :], votes.shape[1], 1) if prior is None else prior
    # Starts from labelers that are right in three of four votes.
    vouched = (votes == 1).any(1)
    post = np.where(vouched, np.clip(0.5 + 0.25 * votes.sum(1), 0.05, 0.95), 0)
    table = prior / prior.sum(2, keepdims=True)
    for _ in range(rounds):
        for truth, w in ((1, post * n), (0, (1 - post) * n)):
            counts = np.einsum("p,plv->lv", w, one_hot) + prior[truth]
            table[truth] = counts / counts.sum(1, keepdims=True)
        share = ((post * n).sum() + 1) / (n.sum() + 2)
        log = [np.log(w) + np.einsum("plv,lv->p", one_hot, np.log(table[t])) for t, w in ((0, 1 - share), (1, share))]
        post = np.where(vouched, 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50))), 0)
    return post, table, share


def reliability_by_kind(kind: np.ndarray, votes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, float]]]:
    """Posterior of every pattern, and each kind's vote distributions and share.

    A labeler means something else for each kind, so each has its own estimate; that
    over all kinds stands in for POOLED candidates of it.
    """
    _, pooled, _ = estimate_reliability(votes, n)
    post, found = np.zeros(len(n)), {}
    for k in np.unique(kind).tolist():
        mine = kind == k
        post[mine], table, share = estimate_reliability(votes[mine], n[mine], prior=POOLED * pooled)
        found[k] = (table, share)
    return post, found


def train_span_classifier(codes: np.ndarray, n: np.ndarray, steps: int = 600) -> dict[int, float]:
    """Probability of personal data for each pattern: EM labels, logistic regression.

    The rows are the corpus's patterns weighted by their counts; every kind weighs
    the same, so that a frequent one does not decide for a rare one.
    """
    if len(codes) == 0:
        return {}
    kind, votes, feats = decode(codes)
    n = n.astype(float)
    labels, _ = reliability_by_kind(kind, votes, n)
    weight = n / np.bincount(kind, n, len(KINDS))[kind]
    family = np.eye(len(KINDS))[kind]
    said = np.hstack([votes == 1, votes == -1]).astype(float)
    by_kind = (family[:, :, None] * said[:, None, :]).reshape(len(codes), -1)
    x = np.hstack([said, by_kind, feats, family, np.ones((len(codes), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 0.3 * (x.T @ (weight * (p - labels)) + 0.002 * w)
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return {int(c): float(v) for c, v in zip(codes, p, strict=True)}


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per input row: id, n_email, n_ip, n_card, n_phone, base_sha256, base, added.

    base lists kind:start:end of the base spans by kind and start; added has the
    spans that the classifier accepts: array<struct<kind, start, stop>>. Offsets
    are code points, ends exclusive.

    Null text counts as empty; a null id stays null; repeated rows are answered
    and counted each; candidates that overlap give way to the earlier, then the
    longer, then the kind listed first; an empty table gives an empty result.
    Other columns are ignored. Ids are longs.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    scanned = materialize(rows.mapInArrow(_scan, _SCAN), "pii-spans")
    # Bounded by kinds x votes x features, whatever the corpus.
    patterns = (
        scanned.select(F.explode(F.concat("base_codes", F.transform("found", lambda f: f["code"]))).alias("code"))
        .groupBy("code")
        .agg(F.count("*").alias("n"))
        .orderBy("code")
        .collect()
    )
    score = train_span_classifier(
        np.array([r["code"] for r in patterns], np.int64), np.array([r["n"] for r in patterns], np.int64)
    )
    good = [c for c, p in score.items() if p >= threshold]
    added = (
        F.filter("found", lambda f: f["code"].isin(good)) if good else F.filter("found", lambda f: F.lit(False))
    )
    names = F.array(*(F.lit(k) for k in KINDS))
    return scanned.select(
        F.col("id").alias(id_col),
        *(f"n_{k}" for k in BASE_KINDS),
        "base_sha256",
        "base",
        F.transform(
            F.array_sort(F.transform(added, lambda f: F.struct(f["kind"], f["start"], f["stop"]))),
            lambda f: F.struct(F.element_at(names, f["kind"] + 1).alias("kind"), f["start"].alias("start"), f["stop"].alias("stop")),
        ).alias("added"),
    )
