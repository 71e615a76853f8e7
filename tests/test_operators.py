import json

from pyspark.sql import functions as F

from corpusloom.functions.signal import wav_bytes
from corpusloom.operators import joins, retry, sequence, stats
from corpusloom.sources import readers, sinks
from corpusloom.streaming import chunks


def test_exclusive_quantiles_follow_the_method(spark):
    import statistics

    values = [*range(1, 12), 50]
    df = spark.createDataFrame([(1, float(v)) for v in values], "g int, v double")
    want = statistics.quantiles(values, n=10)
    got = stats.exclusive_quantiles(df, ["g"], "v", [0.1, 0.9]).first()
    assert abs(got["p10"] - want[0]) < 1e-9 and abs(got["p90"] - want[8]) < 1e-9
    s = df.groupBy("g").agg(*stats.summary("v")).first()
    assert abs(s["p10"] - want[0]) < 1e-9 and s["n"] == 12


def test_positions_and_shards(spark):
    import random

    random.seed(1)
    ids = random.sample(range(100000), 1003)
    out = sequence.contiguous_shards(spark.createDataFrame([(i,) for i in ids], "k long"), "k", 16).collect()
    sizes = [sum(r["shard"] == s for r in out) for s in range(16)]
    assert sizes == [63] * 11 + [62] * 5
    order = [r["shard"] for r in sorted(out, key=lambda r: r["k"])]
    assert order == sorted(order)


def test_overlaps_without_loss_or_repeat(spark):
    import random

    random.seed(2)
    a = [(random.randint(0, 3), s, s + random.randint(0, 40)) for s in random.choices(range(300), k=80)]
    b = [(random.randint(0, 3), s, s + random.randint(0, 40)) for s in random.choices(range(300), k=80)]
    l_df = spark.createDataFrame(list(set(a)), "k int, start long, stop long")
    r_df = spark.createDataFrame(list(set(b)), "k int, a long, b long")
    got = sorted(tuple(r) for r in joins.overlaps(l_df, r_df, ["k"], 16).select("k", "start", "stop", "a", "b").collect())
    want = sorted((k, s, e, x, y) for k, s, e in set(a) for j, x, y in set(b) if k == j and s < y and x < e and s < e and x < y)
    assert got == want


def test_quota_epochs_go_round(spark):
    df = spark.createDataFrame([(i, "a", 1.0) for i in range(5)], "i long, side string, d double")
    first = sorted(r["i"] for r in sequence.quota_epoch(df, "side", "i", "d", {"a": 3.0}, 0).collect())
    second = sorted(r["i"] for r in sequence.quota_epoch(df, "side", "i", "d", {"a": 3.0}, 1).collect())
    assert first == [0, 1, 2] and second == [0, 3, 4]


def test_retry_schedules():
    units = [("a", "x"), ("b", "y"), ("c", "z")]
    ok = lambda out, raw: None if out == raw else "differs"
    plan = ["1. x\n2. bad\n3. z", "1. y"]
    assert [r["attempts"] for r in retry.retry_loop(units, retry.scripted_client(plan), ok)] == [1, 2, 1]
    broken = retry.retry_loop(units[:1], retry.scripted_client(["THROW:500"] * 9), ok)
    assert broken[0]["status"] == "failed" and broken[0]["attempts"] == 4 and "500" in broken[0]["reason"]
    waits = []
    calls = iter([RuntimeError("429"), RuntimeError("429"), "fine"])

    def call():
        x = next(calls)
        if isinstance(x, Exception):
            raise x
        return x

    assert retry.with_backoff(call, sleep=waits.append) == "fine" and waits == [3.0, 6.0]


def test_relay_resume_and_dead_letters(spark):
    df = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, raw string")
    good = lambda out, raw: None if out == raw else "differs"
    first = lambda d: retry.run_retries(d.coalesce(1), lambda: retry.scripted_client(["1. a\n2. x"] + ["1. x"] * 9), good)
    second = lambda d: retry.run_retries(d.coalesce(1), lambda: retry.scripted_client(["1. b"]), good)
    out = {r["id"]: r["status"] for r in retry.relay(df, [first, second]).collect()}
    assert out == {"1": "ok", "2": "ok"}
    assert [r["id"] for r in retry.resume(df, df.where("id = '1'")).collect()] == ["2"]
    dead = retry.dead_letters(df.withColumn("side", F.lit("s")), df.where("id = '1'"), "id", "side", 0).collect()
    assert len(dead) == 1 and not dead[0]["within_cap"]


def test_tolerant_lines_and_sections(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"id": "a", "status": "ok"}\n\nnot json\n{"status": "ok"}\n{"id": "b", "status": "odd"}\n')
    rows = readers.read_jsonl(spark, str(p), "id string, status string", known=["ok", "failed"]).collect()
    assert [(r["id"], r["status"]) for r in rows] == [("a", "ok")]
    lines = spark.createDataFrame([(0, 0, "[one]"), (0, 1, "x"), (0, 2, ""), (0, 3, "[two]"), (0, 4, "y")], "f int, i int, v string")
    got = [(r["section"], r["v"]) for r in readers.read_sections(lines, ["f"], "i", "v").orderBy("i").collect()]
    assert got == [("one", "x"), ("two", "y")]
    cells = spark.range(1).select(readers.markdown_cells(F.lit("A\n| a / b (c) | d |\n|---|---|\nB"), "A", "B").alias("c")).first()["c"]
    assert cells == ["a", "b", "d"]
    assert readers.source_literals("A = {1: 'x'}\nB = f()\n") == {"A": {1: "x"}}


def test_csv_round_trip_and_audio(spark, tmp_path):
    df = spark.createDataFrame([("u1", 'say "hi", you', "train")], "utt string, text string, split string")
    sinks.write_csv(df, str(tmp_path / "out"), ["utt", "text", "split"])
    back = readers.read_csv(spark, str(tmp_path / "out"), ["utt", "text", "split"]).collect()
    assert [tuple(r) for r in back] == [("u1", 'say "hi", you', "train")]
    (tmp_path / "a.wav").write_bytes(wav_bytes([0.0, 0.5, -0.5], 8000))
    probe = readers.probe_audio(spark, str(tmp_path / "*.wav")).first()
    assert (probe["frames"], probe["rate"]) == (3, 8000)
    assert len(readers.read_audio(spark, str(tmp_path / "*.wav")).first()["samples"]) == 3
    m = sinks.manifest(spark.read.format("binaryFile").load(str(tmp_path / "*.wav"))).first()
    assert m["name"] == "a.wav" and len(m["sha256"]) == 64
    assert json.loads(sinks.json_report(df)) == {"utt": "u1", "text": 'say "hi", you', "split": "train"}
    lit = sinks.source_literal(df, "MAP", "utt", "text").first()["source"]
    scope = {}
    exec(lit, scope)  # noqa: S102
    assert scope["MAP"] == {"u1": 'say "hi", you'}
    new = sinks.upsert(df, df.withColumn("text", F.lit("z")), "utt").collect()
    assert [r["text"] for r in new] == ["z"]


def test_paged_listing(spark, tmp_path):
    import http.server
    import threading

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            second = self.path == "/two"
            body = json.dumps([{"path": "b" if second else "a", "size": 1}]).encode()
            self.send_response(200)
            if not second:
                self.send_header("Link", f'<http://127.0.0.1:{self.server.server_port}/two>; rel="next"')
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(readers.ListingSource)
    out = spark.read.format("paged_listing").option("urls", f"http://127.0.0.1:{server.server_port}/one").load().collect()
    server.shutdown()
    assert sorted(r["path"] for r in out) == ["a", "b"]


def test_stream_equals_batch_and_ends_once(spark, sf):
    from corpusloom.plans import sequence_queries

    streamed = sequence_queries.stream_chunks(spark, sf)
    batch = sequence_queries.stream_chunks_batch(spark, sf)
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0
    ends = batch.groupBy("request_id").agg(F.count_if(F.col("status") == "end").alias("n"))
    assert ends.where("n <> 1").count() == 0


def test_interrupts_gaps_and_refusals(spark):
    m = [(1, 1, "feed", "one two three. "), (1, 0, "feed", "zero. "), (1, 2, "interrupt", None), (1, 3, "feed", "late"), (2, 1, "feed", "waits")]
    out = chunks.batch_chunks(spark.createDataFrame(m, chunks.MESSAGE), 2, 5).orderBy("request_id", "chunk").collect()
    assert [(r["request_id"], r["status"]) for r in out] == [(1, "chunk"), (1, "cancelled")]
    raw = spark.createDataFrame([('{"request_id": 1, "seq": 0, "type": "odd", "text": "x"}',)], "value string")
    assert chunks.parse_messages(raw).first()["type"] is None


def test_resumed_stream_repeats_nothing(spark, tmp_path):
    src = f"file://{tmp_path}/in"
    spark.createDataFrame([(1, 0, "feed", "a b c. ")], chunks.MESSAGE).write.mode("append").parquet(src)
    stream = lambda: chunks.stream_chunks(spark.readStream.schema(chunks.MESSAGE).parquet(src), 2, 9)
    chunks.run_to_end(spark, stream(), f"{tmp_path}/out", f"{tmp_path}/state")
    spark.createDataFrame([(1, 1, "feed", "d e f. "), (1, 2, "finish", None)], chunks.MESSAGE).write.mode("append").parquet(src)
    out = chunks.run_to_end(spark, stream(), f"{tmp_path}/out", f"{tmp_path}/state").orderBy("chunk").collect()
    assert [r["text"] for r in out] == ["a b c.", "d e f.", None]


def test_values_at_any_rank(spark):
    import random

    random.seed(3)
    rows = [(random.choice(["a", "b", None]), random.choice([1.0, 2.0, 2.0, 2.0, random.random() * 1e6, -5.0])) for _ in range(500)]
    rows += [("one", 7.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    ranks = {"first": F.lit(1), "third": F.lit(3), "middle": F.floor(F.col("n") / 2) + 1, "last": F.col("n")}
    got = {r["g"]: r for r in stats.values_at(df, ["g"], "v", ranks, cells=8).collect()}
    assert set(got) == {"a", "b", None, "one"}
    for g, r in got.items():
        v = sorted(x for k, x in rows if k == g and x is not None)
        assert (r["n"], r["first"], r["middle"], r["last"]) == (len(v), v[0], v[len(v) // 2], v[-1])
        assert r["third"] == (v[2] if len(v) > 2 else None)


def test_next_value_reads_each_row_once(spark):
    import random

    random.seed(5)
    rows = [(g, None if g == 2 and i == 0 else i, random.choice([None, None, "a", "b"])) for g in range(3) for i in range(40)]
    rows += [(3, i, None) for i in range(3)]
    df = spark.createDataFrame(random.sample(rows, len(rows)), "g int, i int, v string")
    out = df.select("g", "i", sequence.next_value("v", ["g"], "i").alias("next"))
    at = lambda i: -1 if i is None else i
    want = {
        (g, i): next((v for h, j, v in sorted(rows, key=lambda r: at(r[1])) if h == g and at(j) > at(i) and v is not None), None)
        for g, i, _ in rows
    }
    assert {(r["g"], r["i"]): r["next"] for r in out.collect()} == want
    # Spark folds such a frame anew for every row of a group.
    assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()
