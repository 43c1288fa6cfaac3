import json
import random
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Thread

import pytest

import __spark_entry__ as entry
from factloom.functions import text as tx
from factloom.functions.prompts import Prompts
from factloom.functions.vocab import EXTRACTION_TYPES, TYPE_ALIASES, normalize_type, slot_kind
from factloom.operators import chat, distill, extraction, metrics, patterns, retrieve, vectors
from factloom.sources import readers, sinks
from pyspark.sql import functions as F


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


def test_entry_points_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_types(spark):
    for raw, want in [*TYPE_ALIASES.items(), (None, "NONE"), ("", "NONE"), (" food ", "FOOD"), ("body part", "BODY_PART"), ("?", "NONE"), *((t, t) for t in EXTRACTION_TYPES)]:
        assert one(spark, normalize_type(F.col("x")), x=raw) == want
    for raw, want in [("FOOD", "T"), ("food", "c"), ("NONE", "c"), ("", "?"), (" any ", "?"), ("Any", "c")]:
        assert one(spark, slot_kind(F.col("x")), x=raw) == want


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("1. MEM( FOOD ^ lowers ^ cholesterol )", ("FOOD", "lowers", "cholesterol", "Tcc")), ("- `mem(a | b | c`", ("a", "b", "c`", "ccc")), ("MEM(a ^ b ^ c", ("a", "b", "c", "ccc")),
        ("MEM(a, b, c)", None), ("MEM( vitamin B (12) ^ b ^ c )", None), ("MEM(a ^ b ^ LDL (bad) )", ("a", "b", "LDL (bad", "ccc")), ("MEM( ? ^ - ^ any )", None), ("5 mg ^ a ^ b", ("mg", "a", "b", "ccc")), ("", None),
    ],
)
def test_pattern_lines(spark, line, want):
    got = one(spark, patterns.parsed_line(F.col("x")), x=line)
    assert (got and (got.head, got.relation, got.tail, got.shape)) == want


def test_replies_are_deduplicated_by_case(spark):
    rows = spark.createDataFrame([(1, "MEM(a ^ b ^ c)\nMEM(A ^ B ^ C)\nnoise\nMEM(d ^ ? ^ FOOD)"), (2, None)], "qid long, reply string")
    got = patterns.parse_replies(rows)
    assert [(r.pattern_no, r.shape) for r in got.orderBy("pattern_no").collect()] == [(0, "ccc"), (1, "c?T")]
    s = patterns.shape_summary(rows, got).first()
    assert (s.n_queries, s.n_patterns, s.n_empty) == (2, 2, 1)


def test_chunks(spark):
    assert one(spark, tx.chunks(F.col("x"), 3), x="a b\nc\n\nd e f g h\ni") == ["a b\nc", "d e f g h", "i"]
    assert one(spark, tx.fold_chunk_id(F.col("x")), x="a___b") == "a_"
    assert one(spark, tx.strip(F.col("x")), x="\x1c  a b \n") == "a b"


def test_qrels_last_line_counts(spark):
    lines = spark.createDataFrame([(0, "Query-id\td\ts"), (1, "q\td\t1"), (2, "q\td\t2"), (3, "q\td")], "line_no long, value string")
    assert [tuple(r) for r in readers.qrels(lines).collect()] == [("q", "d", 2)]


def test_metrics_by_hand(spark):
    qrels = spark.createDataFrame([("q", "d1", 2), ("q", "d2", 1), ("q", "d3", 0), ("lost", "x", 1), ("none", "x", 0)], "qid string, doc_id string, grade int")
    run = spark.createDataFrame([("s", "q", d, s) for d, s in [("d3", 4.0), ("d1", 3.0), ("d4", 2.0), ("d2", 1.0)]], "system string, qid string, doc_id string, score double")
    got = {r.qid: r for r in metrics.per_query(run, qrels, [2, 4]).collect()}
    from math import log2

    assert got["q"].ndcg_4 == pytest.approx((2 / log2(3) + 1 / log2(5)) / (2 + 1 / log2(3)))
    assert (got["q"].p_2, got["q"].recall_2, got["q"].ap, got["q"].rr) == (0.5, 0.5, 0.5, 0.5)
    assert got["lost"].ndcg_4 == 0 and "none" not in got


def test_bootstrap_properties(spark):
    def run(a, b):
        rows = [("c", i, x, y) for i, (x, y) in enumerate(zip(a, b, strict=True))]
        return metrics.bootstrap(spark.createDataFrame(rows, "comparison string, qid long, a double, b double"), resamples=2000).first()

    same = run([0.5] * 50, [0.5] * 50)
    assert same["diff"] == 0 and same.ties == 50 and same.p > 0.9
    up = run([0.6 + i % 7 / 100 for i in range(400)], [0.5 + i % 5 / 100 for i in range(400)])
    assert up.p < 0.001 and up.wins == 400 and up.ci_low > 0 and up.stars == "***"


def test_aggregation_names():
    for bad in ("sumx", "sum-1", "mean"):
        with pytest.raises(ValueError):
            retrieve.document_score(bad)


def test_extraction_resumes(spark):
    units = spark.createDataFrame([("a", "it is one two three"), ("b", "short and long text here")], "id string, original_text string")
    p = extraction.enqueue(spark.createDataFrame([], extraction.SCHEMA), units)
    ok, bad = (lambda: lambda ts: ts), (lambda: lambda ts: ["x" if t.startswith("short") else t for t in ts])
    extract = lambda: lambda ts: ['{"triplets":[{"e1":"a","verb":"v","e2":""},{"e1":" b ","e1_type":"drug","verb":"","e2":"c"}]}' for _ in ts]
    got = {r.id: r for r in extraction.run_pipeline(p, [ok, bad], extract, F.lit(1.0)).collect()}
    assert got["a"].status == "done" and '"e1":"b"' in got["a"].step4_triplets_json and '"e2":""' not in got["a"].step4_triplets_json
    assert got["b"].status == "pending" and got["b"].attempts == 1 and got["b"].step1_pronoun_resolved and got["b"].step2_references_resolved is None


def test_edits(spark):
    rows = spark.createDataFrame([("he ran far", "Bob ran far", "Bob ran far"), ("a b", "a b", "a c"), ("a b c", "x b c", "a b c new")], "s string, r string, p string")
    m = rows.select(distill.edit_metrics("s", "r", "p").alias("m"))
    assert [r[0] for r in m.select(distill.category(F.col("m"))).collect()] == ["EXACT", "HALLUCINATION", "MISSED ALL"]


def test_replies_are_stripped_before_they_count(spark):
    p = extraction.enqueue(spark.createDataFrame([], extraction.SCHEMA), spark.createDataFrame([("a", "ten signs.")], "id string, original_text string"))
    blanks, extract = (lambda: lambda ts: [" " * 15 for _ in ts]), (lambda: lambda ts: ['{"triplets":[]}'] * len(ts))
    got = extraction.run_pipeline(p, [blanks, blanks], extract, F.lit(1.0)).first()
    assert got.status == "pending" and got.step1_pronoun_resolved is None and "collapsed" in got.error
    padded = lambda: lambda ts: [f"\n {t} " for t in ts]
    got = extraction.run_pipeline(p, [padded, padded], extract, F.lit(1.0), flatten_factory=lambda: lambda ts: [t + " It is flat." for t in ts]).first()
    assert (got.status, got.step2_references_resolved, got.step3_flattened) == ("done", "ten signs.", "ten signs. It is flat.")


def test_the_second_name_of_a_type_counts_where_the_first_is_empty(spark):
    from factloom.operators import facts

    rows = spark.createDataFrame([("d", '[{"e1":"a","e1_type":"","head_type":"FOOD","verb":"v","e2":"b","tail_type":"drug"}]')], "doc_id string, p string")
    got = facts.facts_of_records(rows.select("doc_id", F.explode(facts.payload_records(F.col("p"))).alias("record"))).first()
    assert (got.head_type, got.tail_type) == ("FOOD", normalize_drug(spark))


def normalize_drug(spark):
    return one(spark, normalize_type(F.col("x")), x="drug")


def test_unknown_steps_are_an_error(spark):
    p = extraction.enqueue(spark.createDataFrame([], extraction.SCHEMA), spark.createDataFrame([("a", "text")], "id string, original_text string"))
    with pytest.raises(Exception, match="unknown step"):
        extraction.record(p, spark.createDataFrame([("a", "step9", "x")], "id string, step string, value string"), F.lit(1.0)).collect()


def test_limit_takes_the_rows_that_wait_longest(spark):
    rows = [(f"u{k}", "some text", None, None, None, None, "pending", None, 0, None if k == 3 else float(k)) for k in range(6)]
    ok, extract = (lambda: lambda ts: ts), (lambda: lambda ts: ['{"triplets":[]}'] * len(ts))
    got = extraction.run_pipeline(spark.createDataFrame(rows, extraction.SCHEMA), [ok, ok], extract, F.lit(9.0), limit=2).where("status = 'done'").collect()
    assert {r.id for r in got} == {"u0", "u3"}


def test_repeated_calls():
    rule, waits = chat.Retries(tries=4), []
    answers = iter([chat.Busy("slow", 7.0), RuntimeError("line"), {}, {"triplets": []}])

    def call():
        x = next(answers)
        if isinstance(x, Exception):
            raise x
        return x

    assert chat.persistent(call, rule, keep_empty=False, sleep=waits.append, draw=lambda: 0.5) == {"triplets": []}
    assert waits == [7.0, 4.0, 3.0]
    assert rule.wait(20, None, 1.0) == 180 and rule.wait(0, 0.0, 0.0) == 1
    calls = []
    with pytest.raises(chat.GaveUp):
        chat.persistent(lambda: calls.append(1) or 1 / 0, rule, sleep=waits.append)
    assert len(calls) == 4
    with pytest.raises(chat.Refused):
        chat.persistent(lambda: (_ for _ in ()).throw(chat.Refused("no")), rule, sleep=waits.append)


def test_an_endpoint(spark):
    class Service(BaseHTTPRequestHandler):
        seen = []

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            text = body["messages"][1]["content"]
            self.seen.append(text)
            if text == "bad" or text == "busy" and self.seen.count("busy") < 2:
                self.send_response(400 if text == "bad" else 503)
                self.send_header("Retry-After", "0")
                self.end_headers()
                return
            arguments = {"function": {"arguments": json.dumps({"triplets": [{"e1": text}]})}}
            message = {"content": None, "tool_calls": [arguments]} if "tools" in body else {"content": f" {text}! "}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": message}]}).encode())

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    Thread(target=server.serve_forever, daemon=True).start()
    endpoint, rule = chat.Endpoint(f"http://127.0.0.1:{server.server_port}", "m", "k"), chat.Retries(tries=3, least=0.01)
    rows = spark.createDataFrame([("good",), ("bad",), ("busy",), (None,)], "text string").coalesce(1)
    got = {r.text: r.reply for r in extraction.asked(rows, "text", "reply", chat.chat_model(endpoint, "s", rule)).collect()}
    assert got == {"good": " good! ", "bad": None, "busy": " busy! ", None: None}
    got = {r.text: r.reply for r in extraction.asked(rows, "text", "reply", chat.tool_model(endpoint, "s", Prompts().tool, rule)).collect()}
    assert json.loads(got["good"]) == {"triplets": [{"e1": "good"}]} and got["bad"] is None
    server.shutdown()


def test_replies_are_kept_block_by_block(spark, tmp_path):
    path = str(tmp_path / "cache")
    spark.createDataFrame([(1, "MEM(a ^ b ^ c)")], "qid long, reply string").write.parquet(path)
    queries = spark.createDataFrame([(k, f"q{k}") for k in range(7)], "qid long, text string")
    chat.write_through(queries, path, lambda: lambda ts: [None if t == "q2" else f"<think>x</think> {t} " for t in ts], block=3)
    got = {r.qid: r.reply for r in spark.read.parquet(path).collect()}
    assert got == {1: "MEM(a ^ b ^ c)"} | {k: f"q{k}" for k in (0, 3, 4, 5, 6)}


def test_qrels_files(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "qrels" / "dev.tsv").write_text("query-id\tcorpus-id\tscore\n" + "".join(f"q{k % 50}\td\t{k}\n" for k in range(5000)))
    (tmp_path / "qrel_test.tsv").write_text("q\td\t1\n")
    (tmp_path / "qrels" / "test.tsv").write_text("q\td\t2\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # several splits of one file
    try:
        got = {r.qid: r.grade for r in readers.read_qrels(spark, str(tmp_path), "dev").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {f"q{k}": 4950 + k for k in range(50)}
    assert readers.read_qrels(spark, str(tmp_path), "test").first().grade == 1


def test_nearest_keeps_ties_and_counts(spark):
    r = random.Random(2)
    v = [[r.gauss(0, 1) for _ in range(4)] for _ in range(60)]
    entries = [("text", "none", "", "", k, 1 + k % 3, v[k % 40]) for k in range(60)]  # some vectors twice: ties
    slices = spark.createDataFrame(entries, "subspace string, need string, head_type string, tail_type string, vec_id long, n long, vec array<double>").repartition(3)
    asked = spark.createDataFrame([(q, "text", "none", "", "", 5 + q, v[q]) for q in range(6)], "request_id long, subspace string, need string, head_type string, tail_type string, k int, vec array<double>")
    got = {}
    for x in vectors.nearest(slices, asked).collect():
        got.setdefault(x.request_id, set()).add(x.vec_id)
    for q in range(6):
        score = {e[4]: round(sum(a * b for a, b in zip(v[q], e[6], strict=True)), 6) for e in entries}
        need, total = set(), 0
        for s in sorted(set(score.values()), reverse=True):
            if total >= 5 + q:
                break
            level = {i for i, x in score.items() if x == s}
            need |= level
            total += sum(e[5] for e in entries if e[4] in level)
        assert got[q] == need


def test_diagnostics_and_verdict(spark):
    rows = spark.createDataFrame([("he ran far", "Bob ran far", "Bob ran far"), ("he ran", "Bob ran", "Bob  ran"), ("a b", "a b", "zzzz yyyy xxxx")], "s string, r string, p string")
    rows = rows.withColumn("m", distill.edit_metrics("s", "r", "p"))
    got = {r.s: (r.kind, r.differences) for r in distill.edit_diagnostics(rows, "r", "p").collect()}
    assert got == {"he ran": ("right words, other form", []), "a b": ("outlier", ["a b -> zzzz yyyy xxxx"])}
    met = {r.target: r.met for r in distill.verdict(distill.edit_summary(rows)).collect()}
    assert met["recall"] and not met["hallucinated_share"]
    log = distill.reason_log(spark.createDataFrame([(f"r{k}", "empty" if k else "ok") for k in range(9)], "id string, reason string"))
    assert log.splitlines()[0] == "r1: empty" and log.splitlines()[-1] == "and 3 more" and len(log.splitlines()) == 6


def test_files_go_out_and_come_back(spark, tmp_path):
    (tmp_path / "corpus.jsonl").write_text('{"_id": "a", "title": "T", "text": "one\\ntwo three"}\n{"_id": "b", "text": " "}\n{"_id": "c", "text": "x"}\n')
    (tmp_path / "queries.jsonl").write_text('{"_id": "q", "text": "why"}\n{"_id": "r"}\n')
    path = lambda name: str(tmp_path / name)
    assert {tuple(r) for r in readers.read_corpus(spark, path("corpus.jsonl")).collect()} == {("a", "T\none\ntwo three"), ("c", "x")}
    assert {r.id for r in readers.read_corpus(spark, path("corpus.jsonl"), most_words=2).collect()} == {"a__0", "a__1", "c"}
    assert {tuple(r) for r in readers.read_queries(spark, path("queries.jsonl")).collect()} == {("q", "why"), ("r", "")}
    vectors_ = spark.createDataFrame([("ns_32", "f", "t", [1.0])], "ns string, fingerprint string, text string, vec array<float>")
    sinks.append_vectors(vectors_, path("cache"))
    assert readers.cached_vectors(spark, path("cache"), "ns_32", "f").first().text == "t"
    with pytest.raises(ValueError, match="fingerprint"):
        readers.cached_vectors(spark, path("cache"), "ns_32", "g")
    rows = spark.createDataFrame([("1", "o", "a", "b", "c", "d", True)], f"id string, original_text string, {', '.join(f'{s} string' for s in extraction.STAGES)}, is_eval boolean")
    made = distill.samples(rows, {"step1": "one", "step2": "two", "step4": "six"}).join(rows.select("id", "is_eval"), "id")
    sinks.write_samples(made, path("samples"))
    back = readers.read_samples(spark, path("samples"))
    assert {(r.stage, r.is_eval, r.conversations[2].content) for r in back.collect()} == {("step1", True, "a"), ("step2", True, "b"), ("step4", True, "d")}
    sinks.write_prompts(spark, Prompts(), path("prompts"))
    assert spark.read.json(path("prompts")).first().pronouns == Prompts().pronouns
    runs_ = spark.createDataFrame([("s", "q", "d", 1.0)], "system string, qid string, doc_id string, score double")
    sinks.write_runs(runs_, path("runs"))
    assert tuple(spark.read.json(path("runs")).select("system", "qid", "doc_id", "score").first()) == ("s", "q", "d", 1.0)
    sinks.write_summary(runs_.groupBy("system").count(), path("summary"))
    assert spark.read.json(path("summary")).first()["count"] == 1
    assert metrics.text_table(runs_.select("system", "score")).splitlines() == ["system  score", "s       1.0000"]
    facts = spark.createDataFrame([(1, "d", "h", "v", "t", "FOOD", "DRUGS")], "fact_id long, doc_id string, head string, verb string, tail string, head_type string, tail_type string")
    sinks.write_facts(facts, spark.createDataFrame([("h", [1.0])], "text string, vec array<float>"), path("graph"))
    with pytest.raises(ValueError, match="cover"):
        readers.read_facts(spark, path("graph"))
