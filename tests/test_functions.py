import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import keys, latin, numbers, phonetics, punctuation, repair, segment, signal

ARABIC = st.text(alphabet="ابتثجحخدذرزسشصضطظعغفقكلمنهويةأإآى", min_size=1, max_size=8)


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_nulls_stay_null(spark):
    df = spark.createDataFrame([(None,)], "t string")
    for f in (keys.strip_marks, keys.skeleton, keys.clean_text, keys.norm, latin.transliterate, punctuation.normalize_punctuation, keys.convert_punctuation):
        assert df.select(f(F.col("t")).alias("x")).first()["x"] is None


@pytest.mark.parametrize("n", [0, 1, 10, 11, 19, 20, 21, 99, 100, 101, 999, 1000, 2000, 3000, 11000, 10**6, 2 * 10**9, 10**12 - 1])
def test_number_words_agree_with_running_text(spark, n):
    for style in ("egy", "msa"):
        assert one(spark, numbers.number_words(F.lit(n), style)) == numbers.speak_numbers(str(n), style)


def test_numbers_without_a_reading(spark):
    assert one(spark, numbers.number_words(F.lit(10**12))) is None
    assert one(spark, numbers.number_words(F.lit(-1))) is None
    # A number without a reading keeps its digits, and the rest of the text is read all the same.
    assert numbers.speak_numbers("1000%") == "1000%"
    assert numbers.speak_numbers("5 1234.5 " + "7" * 5000) == f"{numbers.speak_numbers('5')} 1234.5 " + "7" * 5000
    assert numbers.speak_numbers(None) is None


def test_transliteration_takes_pairs_from_the_left():
    def reference(word):
        out, i = "", 0
        single = dict(zip(latin.SINGLE_FROM, latin.SINGLE_TO, strict=True)) | {"x": latin.X}
        while i < len(word):
            if word[i : i + 2] in latin.PAIRS:
                out += latin.PAIRS[word[i : i + 2]]
                i += 2
            else:
                out += single[word[i]]
                i += 1
        return out

    random.seed(3)
    words = {"".join(random.choice("scthgkpoequx") for _ in range(random.randint(1, 9))) for _ in range(3000)} - set(latin.WORDS)
    for w in words:
        spelled = w
        for p in latin._pair_order():
            spelled = spelled.replace(p, latin.PAIRS[p])
        spelled = spelled.translate(str.maketrans(latin.SINGLE_FROM, latin.SINGLE_TO)).replace("x", latin.X)
        assert spelled == reference(w), w


def test_buckwalter_round_trip(spark):
    text = phonetics.ARABIC
    assert one(spark, phonetics.from_buckwalter(phonetics.to_buckwalter(F.lit(text)))) == text


def test_token_inventory():
    assert len(phonetics.SYMBOLS) == 44 and len(set(phonetics.SYMBOLS)) == 44
    assert not set(phonetics.KEEP_Q) & set(phonetics.SAY_G)
    assert (len(phonetics.KEEP_Q), len(phonetics.SAY_G)) == (98, 22)


def test_shadda_order_matters_only_before_it_is_settled(spark):
    swapped = "كَتَ" + "بَّ"
    settled = one(spark, punctuation.normalize_mark_order(F.lit(swapped)))
    assert settled != swapped
    assert phonetics.read_word("katab~a") == ["k", "a", "t", "a", "bb", "a"]
    # Tampered: without the swap the doubled letter is lost.
    assert "bb" not in phonetics.read_word("kataba")


def test_restore_letters():
    assert repair.restore_letters("الأكثر", "الاكثر") == ("الاكثر", 1)
    assert repair.restore_letters("سنة ٢٠٢٤", "سنه 2024") == ("سنه 2024", 5)
    assert repair.restore_letters("202٥", "2024") == ("202٥", 0)
    assert repair.restore_letters("قصير", "طويل جدا") == ("قصير", 0)


def test_post_fixes_and_reply_parsing():
    out, n = repair.post_fixes("الكتاب والله مدرسةْ")
    assert out == "اِلكتاب والله مدرسة" and n == {"al_kasra": 1, "taa_sukun_strip": 1}
    assert repair.parse_numbered("```\n1. a\n٢) b\n```", 2) == ("numbered", ["a", "b"])
    assert repair.parse_numbered("a\nb", 2) == ("plain", ["a", "b"])
    assert repair.parse_numbered("a", 2) == ("unparsed", None)


def test_phrases_applied_in_turn_overwrite_each_other():
    p = [repair.Phrase(["الحمد", "لله"], ["X", "Y"]), repair.Phrase(["لله"], ["Z"])]
    assert repair.apply_phrases("(الحمد لله.)", p) == ("(X Z.)", [0, 1], ["الحمد لله", "لله"])


@settings(max_examples=50, deadline=None)
@given(st.lists(ARABIC, min_size=1, max_size=6))
def test_repair_keeps_letters_and_is_idempotent_on_words(words):
    raw = " ".join(words)
    r = repair.Repairer(repair.Lexicon())
    first = r.repair(raw, raw)
    assert first["skeleton_ok"]
    assert repair.strip(first["out"]) == raw


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab .!?\n،؛", max_size=200), st.integers(1, 9))
def test_chunker_loses_and_repeats_nothing(text, step):
    c = segment.StreamChunker(segment.word_size, 3, 8, __import__("re").compile(r"[\w.!?،؛]"))
    out = [x for i in range(0, len(text), step) for x in c.feed(text[i : i + step])] + c.finish()
    assert " ".join(out).split() == text.split()
    assert all(len(x.split()) <= 8 for x in out)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab .!،\n", max_size=80))
def test_sentence_spans_cover_all_but_white_space(text):
    spans = segment.sentence_spans(text)
    assert all(a < b and not text[a].isspace() and not text[b - 1].isspace() for a, b in spans)
    assert "".join("".join(text[a:b].split()) for a, b in spans) == "".join(text.split())


def test_plan_units_respect_caps():
    text = "كلمة " * 100 + ". " + "اخرى، " * 30
    units = segment.plan_units(text, 60.0, 400)
    n = len(text)
    assert all(60.0 * (b - a) / n <= 11.0 and 400 * (b - a) / n <= 145 for a, b in units)
    assert "".join("".join(text[a:b].split()) for a, b in units) == "".join(text.split())


def test_wave_round_trip_and_levels(spark):
    x = np.sin(np.arange(4000) / 5)
    data = signal.wav_bytes(x, 8000)
    y, rate = signal.read_wav(data)
    assert rate == 8000 and np.abs(x - y).max() < 1e-3
    assert signal.wav_header(data) == (4000, 8000, 1, 2)
    assert abs(signal.pitch(np.sin(2 * np.pi * 200 * np.arange(4000) / 8000), 8000) - 200) < 5
    assert len(signal.resample(x, 8000, 4000)) == 2000
    assert signal.to_pcm16(np.array([2.0, -2.0])).tolist() == [32767, -32767]
    assert one(spark, F.size(signal.frame_levels(F.lit([1.0, 1.0, 1.0, 1.0, 1.0]), 2, 2))) == 2


def test_monotonic_alignment_uses_every_token():
    rng = np.random.default_rng(0)
    for _ in range(20):
        d = signal.monotonic_alignment(rng.random((12, 5)))
        assert d.sum() == 12 and (d > 0).all()


def test_markers(spark):
    t = "القلم {ق} ثم كلمة"
    assert one(spark, punctuation.bind_markers(F.lit(t))) == "القلم{ق} ثم كلمة"
    parts = one(spark, punctuation.split_markers(F.lit("القلم{ق} ثم")))
    assert [(p["word"], p["marker"]) for p in parts] == [("القلم", "{ق}"), ("ثم", "")]
    assert punctuation.restore_edges("«نعم»، لا", "نَعَم لَا") == "«نَعَم»، لَا"
    assert punctuation.restore_edges("a b", "a") == "a"
