import json

from pyspark.sql import functions as F

from quillspark.functions import rendering
from quillspark.sources import readers, writers
from quillspark.streaming import clients, resume


def test_readers(spark, tmp_path):
    (tmp_path / "gt.json").write_text(json.dumps([{"id": "a", "code": "1"}, {"id": "b", "code": "2"}, {"id": "a", "code": "3"}]))
    got = {r.code_id: r.code for r in readers.ground_truth(spark, str(tmp_path / "none.json"), str(tmp_path / "gt.json")).collect()}
    assert got == {"a": "3", "b": "2"}
    (tmp_path / "ocr.jsonl").write_text('{"code_id":"a","ratio":1.5,"text":"x"}\n\n{bad\n{"code_id":"b","ratio":2,"error":"e","image_path":"p"}\n')
    assert readers.ocr_results(spark, str(tmp_path / "ocr.jsonl")).count() == 2
    assert {r[0] for r in readers.done_set(spark, str(tmp_path / "ocr.jsonl")).collect()} == {"a|1.5", "b|2.0", "p"}
    qa = [{"context": "c", "question": "q", "options": {"B": "2", "A": "1"}, "answer": "A"}, {"context": " ", "answer": "B"}]
    (tmp_path / "qa.json").write_text(json.dumps(qa))
    row = readers.qa_items(spark, str(tmp_path / "qa.json")).collect()
    assert len(row) == 1 and row[0].options_text == "A. 1\nB. 2\n"


def test_files(spark, tmp_path):
    d = tmp_path / "pairs"
    d.mkdir()
    for i in (10, 2, 1):
        (d / f"p_{i}.py").write_text(f"a{i}\n\n\nb{i}\n" if i != 1 else "single")
    rows = readers.clone_pairs(spark, str(d), 5).collect()
    assert [(r.file, r.left, r.right) for r in rows] == [("p_2.py", "a2", "b2"), ("p_10.py", "a10", "b10")]
    assert {r.language for r in readers.code_files(spark, str(d)).collect()} == {"python"}
    (d / "x.PNG").write_bytes(b"1")
    assert readers.image_files(spark, str(d)).count() == 1
    assert readers.code_or_sample(spark, None, None, "s").first().code == "s"
    assert readers.env_flag("Yes") and not readers.env_flag(None)
    assert readers.key_from_env_file('# K=1\nexport K="v"\n', "K") == "v"


def test_completion_rows(spark):
    background = "x = 1\n" * 3000
    rows = spark.createDataFrame([(0, "a", background + "def f():\n  pass", "g"), (1, "b", "def f():\n  pass", "g")], "pos long, id string, context string, gt string")
    assert [r.id for r in readers.completion_rows(rows).collect()] == ["a"]
    assert readers.completion_rows(rows, wanted=2).count() == 2  # the small-set fallback
    other = readers.completion_rows(rows, language="go", least_tokens=0, most_lines=10**6)
    assert other.count() == 2


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("m", 1), ("n", 2)], "mode string, v int")
    writers.write_by_mode(rows, str(tmp_path / "out"))
    writers.append_records(rows, str(tmp_path / "log"))
    writers.append_records(rows, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    assert json.loads(writers.report_json(rows).first()[0])["results"][0] == {"mode": "m", "v": 1}
    assert rows.limit(1).select(writers.page_name(F.lit(7), F.lit(2.0))).first()[0] == "page_007_ratio2.png"


def test_stream_resumes(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    truth = spark.createDataFrame([("a", "abcd"), ("b", "xy")], "code_id string, code string")
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.jsonl").write_text('{"code_id":"a","ratio":1,"text":"abd"}\n{"code_id":"z","ratio":1,"text":"q"}\n')
    run = lambda: resume.append_new(resume.score_stream(resume.result_stream(spark, src), truth), out, check).awaitTermination(60)
    run()
    (tmp_path / "in/2.jsonl").write_text('{"code_id":"a","ratio":1,"text":"abcd"}\n{"code_id":"b","ratio":2,"text":"xy"}\n')
    run()
    got = sorted((r.code_id, r.ratio, r.cer) for r in spark.read.parquet(out).collect())
    assert got == [("a", 1.0, 0.25), ("b", 2.0, 0.0)]


def test_client_retries():
    class Flaky:
        calls = 0

        def ask(self, prompt, images):
            self.calls += 1
            if self.calls < 3:
                raise OSError("down")
            return {"output": "ok"}

    waits = []
    got = clients.ask_with_retries(Flaky(), "p", [], clients.Policy(sleep=waits.append))
    assert got["output"] == "ok" and waits == [1.0, 2.0]
    down = clients.ask_with_retries(Flaky(), "p", [], clients.Policy(tries=2, sleep=waits.append))
    assert down["output"] == "" and "down" in down["error"]


def test_rows_and_colours(spark):
    d = spark.createDataFrame([(1, "ab" * 40 + "\n\nc")], "i int, code string")
    rows = rendering.page_rows(d, "code", F.lit(224), F.lit(10)).orderBy("page", "row").collect()
    assert [len(r.text) for r in rows] == [36, 36, 8, 0, 1] and [r.row for r in rows] == list(range(5))
    t = d.select(rendering.syntax_tokens()(F.lit("def f(): pass"), F.lit("python")).alias("t")).first().t
    assert "".join(x.text for x in t).strip() == "def f(): pass" and t[0].color == "#0000FF"


def test_command_line(spark, tmp_path, capsys):
    from quillspark import __main__ as cli

    (tmp_path / "a.go").write_text("func f() {\n}\n" * 40)
    (tmp_path / "b.go").write_text("func g() {\n}\n" * 40)
    cli.main(["plan", str(tmp_path / "a.go"), "--ratio", "2"])
    got = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert got["language"] == "go" and got["pages"] == 1 and got["num_lines"] == 81
    cli.main(["score", str(tmp_path / "a.go"), str(tmp_path / "b.go")])
    got = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert 0 < got["cer"] < 0.1 and not got["exact"]


def test_streaming_counts(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", 1.0, 0.5), ("2024-01-01 00:50:00", 1.0, 0.0), ("2024-01-01 01:10:00", 2.0, 0.0)], "ts string, ratio double, cer double")
    rows.select(F.col("ts").cast("timestamp").alias("ts"), "ratio", "cer").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, ratio double, cer double").parquet(str(tmp_path / "in"))
    q = resume.ratio_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    assert sorted((r.ratio, r.n, r.cer) for r in spark.table("counts").collect()) == [(1.0, 2, 0.25), (2.0, 1, 0.0)]
