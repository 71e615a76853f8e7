"""Readers, writers, splitting at pauses, guarded work, leases, boxed streams and arrivals."""

import io
import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import keys, segment, split
from corpusloom.operators import gates, sequence, work
from corpusloom.sources import readers, sinks


def words(t):
    return len(t.split())


def test_batch_chunks_lose_no_word_and_keep_the_cap():
    text = "كلمة أولى. ثم كلمة،" + " نص" * 30 + "\nسطر! " + " ".join(f"كلمة{i}" for i in range(50)) + "؛ آخر"
    for cap in (5, 12, 40, 160):
        out = segment.batch_chunks(text, words, cap)
        assert " ".join(out).split() == text.split()
        assert all(words(c) <= cap for c in out)
    assert segment.batch_chunks("", words) == [] and segment.batch_chunks("only latin", words) == []
    # Sentences below six words join the one before; neighbours join up to nine tenths of the cap.
    assert segment.batch_chunks("نص. نص. نص.", words, 160) == ["نص. نص. نص."]


def test_gates_as_they_are_reported(spark):
    row = spark.createDataFrame([("مَدْرَسَةُ", "مدرسة"), ("كِتَابْ", "كتاب"), ("كِتَابٌ", "كتب")], "o string, r string")
    got = [tuple(r[0])[:4] for r in row.select(gates.measured(F.col("o"), F.col("r"), [])).collect()]
    assert got == [(True, True, False, True), (True, True, True, True), (False, False, True, True)]


def test_stems(spark):
    forms = ["دينهم", "دينار", "حساباتنا", "قضاء", "قضاءه", "ربنا", "رباط", "والاخره", "عقبه", "عقبات"]
    rows = spark.createDataFrame([(f,) for f in forms], "k string").select("k", F.explode(keys.stem_candidates(F.col("k"))).alias("h"))
    assert {(r["k"], r["h"]["stem"], r["h"]["genuine"]) for r in rows.collect()} == {
        ("دينهم", "دين", True), ("دينار", "دين", False), ("حساباتنا", "حساب", True), ("قضاء", "قضاء", True), ("قضاءه", "قضاء", False),
        ("ربنا", "رب", True), ("رباط", "رب", False), ("والاخره", "آخرة", True), ("عقبه", "عقبة", True), ("عقبات", "عقبة", False),
    }


def test_readers_and_writers(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "b"', 0.5), (2, None, 1.5)], "k int, t string, x double")
    sinks.write_json_array(rows, str(tmp_path / "array"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "array").glob("part-*")))
    assert json.loads(text) == [{"k": 1, "t": 'a "b"', "x": 0.5}, {"k": 2, "x": 1.5}]
    sinks.write_json_array(rows.limit(0), str(tmp_path / "none"))
    assert json.loads("".join(p.read_text() for p in (tmp_path / "none").glob("part-*"))) == []
    (tmp_path / "t.csv").write_text("n,d,s\n1,2024-05-01,x\n2,2024-05-02,y\n")
    assert [t for _, t in readers.read_csv_inferred(spark, str(tmp_path / "t.csv")).dtypes] == ["int", "date", "string"]
    (tmp_path / "look.json").write_text(json.dumps({"closed": ["a", "b"], "forms": {"k": "v"}}))
    schema = "closed array<string>, forms map<string,string>"
    assert {r["value"] for r in readers.read_lookup(spark, str(tmp_path / "look.json"), schema, "closed").collect()} == {"a", "b"}
    assert [tuple(r) for r in readers.read_lookup(spark, str(tmp_path / "look.json"), schema, "forms").collect()] == [("k", "v")]
    for name, lines in (("b.txt", "3\n4\n"), ("a.txt", "1\n2\n")):
        (tmp_path / name).write_text(lines)
    found = readers.read_lines_in_order(spark, str(tmp_path / "*.txt")).orderBy("file", "line").collect()
    assert [(r["line"], r["value"]) for r in found] == [(0, "1"), (1, "2"), (0, "3"), (1, "4")]
    buffer = io.BytesIO()
    np.savez(buffer, x=np.arange(6).reshape(2, 3), y=np.array([0.5]))
    (tmp_path / "t.npz").write_bytes(buffer.getvalue())
    found = {r["name"]: (r["shape"], r["values"]) for r in readers.read_tensors(spark, str(tmp_path / "t.npz")).collect()}
    assert found == {"x": ([2, 3], [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]), "y": ([1], [0.5])}


def recording(seconds, pauses, rate=1000):
    x = np.sin(np.arange(int(seconds * rate)) * 0.9) * 0.5
    for at in pauses:
        x[int((at - 0.1) * rate) : int((at + 0.1) * rate)] = 0
    return x


def test_recordings_are_cut_at_pauses(spark):
    text = " ".join("جملة فيها عدة كلمات طويلة هنا." for _ in range(6))
    x = recording(24, [4, 8, 12, 16, 20])
    out = split.split_units(text, x, 1000)
    assert len(out.units) >= 3 and not out.dropped
    # Units are neighbours, each within the limits, and together hold all words.
    assert [a for _, a, _ in out.units][1:] == [b for _, _, b in out.units][:-1]
    assert all(3000 <= b - a <= 11000 for _, a, b in out.units)
    assert " ".join(t for t, _, _ in out.units).split() == text.split()
    # Without a pause nothing can be cut, and what is too long goes.
    loud = split.split_units(text, recording(24, []), 1000)
    assert not loud.units and loud.dropped
    assert split.split_units(text[:60], recording(5, []), 1000, 40).units == [(text[:60].strip(), 0, 5000)]
    assert split.split_units("", x, 1000).dropped == [("row", "no text")] and split.split_units("a", x[:100], 1000).dropped == [("row", "short")]
    df = spark.createDataFrame([(1, text, x.tolist(), 1000), (2, None, None, None), (3, text, [], 1000)], "k int, t string, s array<double>, r int")
    rows = split.split_recordings(df, "k", "t", "s", "r").orderBy("k", "unit").collect()
    assert [(r["text"], r["first"], r["last"]) for r in rows] == out.units and {r["k"] for r in rows} == {1}


def test_a_unit_that_is_too_long_is_planned_anew():
    # One pause only is near the border that the text alone suggests; the halves are cut again at their own.
    text = " ".join(f"جملة رقم فيها كلام طويل جدا ومفيد{'،' if i % 2 else '.'}" for i in range(12))
    x = recording(40, [3.4, 6.7, 10, 13.4, 16.7, 20, 23.4, 26.7, 30, 33.4, 36.7])
    out = split.split_units(text, x, 1000)
    assert out.units and all(b - a <= 11000 for _, a, b in out.units)


def test_guarded_work_never_raises(spark):
    df = spark.createDataFrame([(1, "5"), (2, "x"), (3, None)], "k int, v string")
    got = {r["k"]: (r["result"], r["status"].split(":")[0]) for r in work.guarded(df, "k", lambda r: str(int(r["v"]) + 1)).collect()}
    assert got == {1: ("6", "ok"), 2: (None, "ValueError"), 3: (None, "TypeError")}


def test_leases_have_one_holder(spark, tmp_path):
    now = [0.0]
    clock = lambda: now[0]
    a, b = (work.Leases(spark, f"file://{tmp_path}", 300, clock) for _ in range(2))
    now[0] = __import__("time").time()
    assert a.take("s1") and not b.take("s1") and b.take("s2")
    a.finish("s1", good=True)
    assert not b.take("s1")  # final
    b.finish("s2", good=False)
    assert a.take("s2")
    now[0] += 301
    assert b.take("s2")  # the holder is gone


def test_boxed_runs_go_on(spark, tmp_path):
    for i in range(3):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / f"in/{i}.txt").write_text(f"{i}\n")
    stream = spark.readStream.option("maxFilesPerTrigger", 1).text(f"{tmp_path}/in")
    for _ in range(4):
        if work.run_boxed(stream, f"{tmp_path}/out", f"{tmp_path}/ck", 60):
            break
    assert sorted(r["value"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["0", "1", "2"]


def test_arrivals_end_with_the_whole_text():
    text = "first sentence is here now. and a second one, with more words! the rest"
    chunker = segment.StreamChunker(words, 3, 8, re.compile(r"\w"))
    out = work.arrivals(text, [5, 1], chunker)
    assert " ".join(c for _, _, c in out).split() == text.split()
    assert [a for a, _, _ in out] == sorted(a for a, _, _ in out) and out[-1][0] == len(text)
    assert all(used <= at for at, used, _ in out)


def test_positions_of_values_that_lie_close(spark):
    values = [1, 2, 3, 10**12] + list(range(1000, 1200)) + [None]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    got = {r["v"]: r["position"] for r in sequence.positions(df, "v").collect()}
    assert got.pop(None) is None and got == {v: i for i, v in enumerate(sorted(x for x in values if x is not None))}


@pytest.mark.parametrize("cap", [1, 10, 25])
def test_batches_are_those_of_a_plain_fold(spark, cap):
    rng = np.random.default_rng(cap)
    rows = [(["a", "b", None][i % 3], i, int(rng.integers(0, 12))) for i in range(200)]
    want, state = {}, {}
    for g, i, s in rows:
        number, held = state.get(g, (0, 0))
        if held > 0 and held + s > cap:
            number, held = number + 1, 0
        state[g] = (number, held + s)
        want[i] = number
    df = spark.createDataFrame(rows, "g string, i int, s int")
    assert {r["i"]: r["batch"] for r in sequence.byte_batches(df, ["g"], "i", "s", cap).collect()} == want
