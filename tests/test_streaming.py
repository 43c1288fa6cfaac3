import json

from factloom.streaming.resume import extract_stream


def test_stream_runs_each_file_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    ok, extract = (lambda: lambda ts: ts), (lambda: lambda ts: ['{"triplets":[{"e1":"a","verb":"v","e2":"b"}]}'] * len(ts))
    for k in range(2):
        (source / f"{k}.json").write_text(json.dumps({"id": f"d{k}", "original_text": "some text"}) + "\n")
        extract_stream(spark, str(source), str(tmp_path / "out"), str(tmp_path / "cp"), [ok, ok], extract).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.id, r.status) for r in got.collect()) == [("d0", "done"), ("d1", "done")]


def test_attempts_add_up_over_batches(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    ok, none = (lambda: lambda ts: ts), (lambda: lambda ts: ["no JSON"] * len(ts))
    for k in range(3):
        (source / f"{k}.json").write_text(json.dumps({"id": "d", "original_text": "some text"}) + "\n")
        extract_stream(spark, str(source), str(tmp_path / "out"), str(tmp_path / "cp"), [ok, ok], none).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.attempts, r.status) for r in got.collect()) == [(1, "pending"), (2, "pending"), (3, "failed")]
