import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import diacritic_tokens as d
from corpusloom.functions import signal
from corpusloom.functions.phonetics import read_utterance
from corpusloom.operators import reports

TEXTS = ["الشَّمْسُ سَاطِعَةٌ", "كَتَبَ", "مُدَرِّسٌ جَدِيدٌ"]


def settled(text):
    """A shadda before its vowel, however it was typed."""
    return re.sub("([\u064b-\u0650])(\u0651)", r"\2\1", text)


def test_letters_and_marks_go_back_together():
    labels = d.Labels(TEXTS)
    for t in TEXTS:
        assert labels.decode(*labels.encode(t)) == settled(t)
    swapped = "كَتَبََّ"
    assert d.join(d.split(swapped)) == settled("كَتَبَّ")
    assert d.join(d.without_case_endings(d.split("كَتَبَ مُدَرِّسٌ"))) == settled("كَتَب مُدَرِّس")
    assert d.split("ـabكـ") == [("ك", d.NONE)]


def test_safety_by_spelling_and_by_sound():
    key = lambda w: tuple(t for t in read_utterance(w) if t not in ("_+_", "_eos_"))
    check = d.safety_check({"kt'b": 1, "qlm": 2}, key)
    assert check("qlm") == [(2, "qlm", "spelling")]
    assert check("kt>b") == [(1, "kt'b", "phoneme")]
    assert check("xyz") == [] and check("") == []


def test_pause_and_continuity():
    rate = 8000
    x = np.concatenate([np.sin(np.arange(rate)), np.zeros(rate // 4), np.sin(np.arange(rate))])
    at = signal.find_pause(x, rate, 1.1)
    assert rate <= at <= rate * 1.25
    assert signal.find_pause(np.sin(np.arange(rate)), rate, 0.5) is None
    c = signal.Continuity(gap=10)
    loud = c.push(np.full(100, 0.5))
    soft = c.push(np.full(100, 0.4))
    assert len(loud) == 100 and len(soft) == 110 and abs(soft[-1] - 0.5) < 1e-9


def test_checked_updates_refuse_surprises(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    change = spark.createDataFrame([(1, "z", "a", "why")], "k int, new string, old string, why string")
    out, log = reports.audited_update(df, change, "k", "v")
    assert sorted(map(tuple, out.collect())) == [(1, "z"), (2, "b")] and [tuple(r) for r in log.collect()] == [(1, "a", "z", "why")]
    with pytest.raises(Exception, match="unexpected value"):
        reports.audited_update(df, change.withColumn("old", F.lit("q")), "k", "v")[0].collect()


def test_small_parts(spark):
    one = spark.range(1)
    assert one.select(reports.inverted(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(1))).alias("m")).first()["m"] == {1: "b"}
    assert reports.disjoint(one.where("id > 5"), one, "id")
    with pytest.raises(ValueError):
        reports.cross_product(spark.range(10), spark.range(10), most=50)
    loads = []
    get = reports.cached_models(lambda n: loads.append(n) or n, 2)
    assert [get(x) for x in "abab"] == list("abab") and loads == ["a", "b"]


def test_bands_and_bursts():
    rate = 8000
    x = np.concatenate([np.zeros(800), np.sin(2 * np.pi * 1000 * np.arange(1600) / rate)])
    share = signal.band_energies(x, rate, [(0, 500), (500, 1500), (1500, 4000)])
    assert share.argmax() == 1 and share[1] > 0.9
    assert abs(signal.burst_onset(x, rate) - 0.1) < 0.01
    assert signal.burst_onset(np.zeros(100), rate) is None and signal.band_energies(np.zeros(600), rate, [(0, 1)])[0] == 0


def test_soft_ends_and_prepared_text(spark):
    from corpusloom.functions import punctuation, segment

    c = segment.StreamChunker(segment.word_size, 2, 9, re.compile(r"\w"), segment.CLAUSE_END)
    assert c.feed("a b, c d. e") == ["a b,", "c d."] and c.finish() == ["e"]
    p = spark.createDataFrame([("عندي 5 {ق}",)], "t string").select(punctuation.prepare_text(F.col("t")).alias("p")).first()["p"]
    assert p["normalized"].startswith("عندي خمسة") and p["numbers"] and not p["latin"] and p["markers"] == 1 and p["vocalize"]


def test_downloads_leave_no_parts(spark, tmp_path):
    import http.server
    import threading

    from corpusloom.sources import readers

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200 if self.path == "/a" else 404)
            self.end_headers()
            if self.path == "/a":
                self.wfile.write(b"data")

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    assert readers.fetch(f"{base}/a", str(tmp_path / "x")) == 4
    waits = []
    with pytest.raises(OSError):
        readers.fetch(f"{base}/b", str(tmp_path / "y"), tries=3, sleep=waits.append)
    assert waits == [1.0, 2.0] and sorted(p.name for p in tmp_path.iterdir()) == ["x"]
    out = readers.fetch_all(spark.createDataFrame([(f"{base}/a", "z")], "url string, name string"), str(tmp_path)).first()
    server.shutdown()
    assert tuple(out) == ("z", 4, None)
