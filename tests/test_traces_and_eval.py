"""Span trees, ids, GenAI projection, assertions, comparison, tables and streams on literals."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skeinwatch.functions import scalars, timeutil
from skeinwatch.operators import compare, evaluate, genai, traces
from skeinwatch.operators.evaluate import Task
from skeinwatch.plans import registry, views
from skeinwatch.sources import tables
from skeinwatch.streaming import outbox, samples, streams

T0 = datetime(2024, 1, 1)
SPAN = "trace_id string, span_id string, parent_span_id string, service_name string, span_name string, start_time timestamp, end_time timestamp, status_code int, status_message string, attributes map<string,string>"


def spans_of(spark, rows):
    return spark.createDataFrame(
        [
            (t, s, p, "svc", s, T0 + timedelta(seconds=a), T0 + timedelta(seconds=a + 1), c, "bad" if c == 2 else None, {"k": s}) for t,
            s,
            p,
            a,
            c in rows
        ],
        SPAN,
    )


def test_span_tree_with_orphans_and_without_root(spark):
    df = spans_of(
        spark,
        [
            ("t", "a", None, 0, 1),
            ("t", "c", "a", 2, 1),
            ("t", "b", "a", 1, 1),
            ("t", "d", "b", 3, 2),
            ("t", "x", "gone", 0, 1),
            ("u", "p", "q", 1, 1),
            ("u", "q", "p", 0, 1),
        ],
    )
    got = {(r["trace_id"], r["span_id"]): r for r in traces.span_tree(df).collect()}
    assert [got["t", s]["span_order"] for s in "abdcx"] == [0, 1, 2, 3, 4]
    assert got["t", "d"]["path"] == ["a", "b", "d"] and got["t", "d"]["depth"] == 2
    assert got["t", "x"]["depth"] == 0 and got["t", "x"]["path"] == ["x"] and got["t", "x"]["root_span_id"] == "a"
    assert got["u", "p"]["root_span_id"] == "q" and {got["u", s]["depth"] for s in "pq"} == {0}
    assert {(r["trace_id"], r["span_id"]): r for r in traces.span_tree(df, 3).collect()} == got  # larger traces go by joins


def test_span_depths_reach_every_span(spark):
    rows = [("t", f"c{i:03}", f"c{i - 1:03}" if i else None, i, 1) for i in range(70)] + [("t", "x", "gone", 0, 1), ("t", "y", "x", 1, 1)]
    rows += [("u", "p", "q", 1, 1), ("u", "q", "p", 0, 1), ("u", "r", "p", 2, 1)]
    got = {(r["trace_id"], r["span_id"]): r["depth"] for r in traces.span_depths(spans_of(spark, rows)).collect()}
    assert got == {(t, s): int(s[1:]) if s[0] == "c" else 0 for t, s, *_ in rows}


def test_summaries_and_late_parts_agree(spark):
    df = spans_of(spark, [("t", "a", None, 0, 1), ("t", "b", "a", 1, 2), ("t", "c", "a", 5, 1)])
    whole = traces.trace_summaries(df).first()
    assert (
        whole["root_operation"],
        whole["span_count"],
        whole["error_count"],
        whole["status_code"],
        whole["status_message"],
        whole["duration_ms"],
    ) == ("a", 3, 1, 2, "bad", 6000)
    parts = traces.trace_summaries(df.where("span_id <> 'c'")).unionByName(traces.trace_summaries(df.where("span_id = 'c'")))
    merged = traces.merge_summaries(parts).first()
    assert (merged["span_count"], merged["duration_ms"], merged["root_operation"]) == (3, 6000, "a")


def test_ids_and_dispatch(spark):
    uid = "00000000-0000-4000-8000-00000000000{}".format
    df = spans_of(spark, [("t", "a", None, 0, 1)]).withColumn(
        "attributes",
        F.create_map(*(F.lit(x) for x in (traces.ENTITY_PREFIX + ".x", uid(1), traces.ENTITY_PREFIX, "not a uuid"))),
    )
    event = F.struct(
        F.lit("e").alias("name"),
        F.create_map(F.lit(traces.ENTITY_PREFIX), F.lit(uid(2)), F.lit(traces.QUEUE_KEY), F.lit(uid(3))).alias("attributes"),
    )
    got = traces.extract_ids(df.withColumn("events", F.array(event)))
    events = {(r["entity_id"], r["event"]) for r in traces.dispatch_events(got).collect()}
    assert events == {(uid(1), "candidate"), (uid(2), "ack")}


def test_paging_both_ways(spark):
    df = spark.range(10).select((F.col("id") % 3).alias("t"), "id")
    first = timeutil.page(df, ["t", "id"], 4)
    second = timeutil.page(df, ["t", "id"], 4, first["next_cursor"])
    back = timeutil.page(df, ["t", "id"], 4, second["previous_cursor"], "previous")
    assert first["has_next"] and not first["has_previous"] and back["rows"] == first["rows"] and not back["has_previous"]
    last = timeutil.page(df, ["t", "id"], 4, second["next_cursor"])
    assert len(last["rows"]) == 2 and not last["has_next"]


def test_genai_coercions(spark):
    base = {
        "gen_ai.operation.name": "chat",
        "gen_ai.usage.input_tokens": "12.0",
        "gen_ai.usage.output_tokens": "x",
        "gen_ai.response.finish_reasons": "stop",
    }
    scored = [
        ("gen_ai.evaluation.result", {"gen_ai.evaluation.name": "q", "gen_ai.evaluation.score.value": "0.5"}),
        ("gen_ai.evaluation.result", {"other": "1"}),
        ("m", {"gen_ai.request.model": "late"}),
    ]
    df = spark.createDataFrame(
        [("a", base, scored), ("b", {"x": "y"}, [])],
        "span_id string, attributes map<string,string>, events array<struct<name:string,attributes:map<string,string>>>",
    )
    row = genai.extract_genai(df).first()
    assert genai.extract_genai(df).count() == 1
    assert (row["input_tokens"], row["output_tokens"], row["finish_reasons"], row["request_model"]) == (12, None, ["stop"], "late")
    assert json.loads(row["evaluations"]) == [{"name": "q", "score": 0.5}]


CASES = [
    ({"v": 300}, "equals", 300.0, True),
    ({"v": "3"}, "equals", 3, True),
    ({"v": [1, 2]}, "equals", [1, 2], True),
    ({"v": None}, "is_null", None, True),
    ({"v": "abc"}, "has_length_equal", 3, True),
    ({"v": {"a": 1}}, "is_object", None, True),
    ({"v": "a.b c"}, "contains_word", "b", True),
    ({"v": "abc"}, "contains_word", "b", False),
    ({"v": "x@y.org"}, "is_email", None, True),
    ({"v": "2024-01-01T00:00:00Z"}, "is_iso8601", None, True),
    ({"v": "{\"a\":1}"}, "is_json", None, True),
    ({"v": 5}, "in_range", [1, 5], True),
    ({"v": [1, 2, 3]}, "contains_all", [3, 1], True),
    ({"v": [1, 2]}, "sequence_matches", [1, 2.0], True),
    ({"v": [1, 1]}, "has_unique_items", None, False),
    ({"v": []}, "is_empty", None, True),
    ({"v": "ABC1"}, "is_uppercase", None, True),
    ({"v": "123"}, "is_uppercase", None, False),
    ({"v": [5, 6]}, "greater_than", 4, True),
    ({"v": [5, 3]}, "greater_than", 4, False),
    ({"v": "text"}, "greater_than", 1, False),
    ({"v": 10.05}, "approximately_equals", [10, 0.1], True),
    ({"v": "http://a.b/c"}, "is_url", None, True),
    ({"v": [1, "2"]}, "contains", 2, True),
    ({"v": "abc"}, "contains_any", ["x", "b"], True),
]


@pytest.mark.parametrize(("context", "operator", "expected", "passed"), CASES)
def test_operators(spark, context, operator, expected, passed):
    df = spark.range(1).select(F.lit("r").alias("record_id"), F.parse_json(F.lit(json.dumps(context))).alias("context"))
    row = evaluate.evaluate(df, [Task("t", operator, expected, "v")]).first()
    assert row["passed"] == passed
    assert (row["error"] is not None) == (context["v"] == "123")


def test_paths_templates_items_and_gates(spark):
    context = {"input": {"foo": "bar", "baz": [1, 2, 3]}, "responses": [{"text": "hello"}, {"text": "world"}], "want": "bar"}
    df = spark.range(1).select(F.lit("r").alias("record_id"), F.parse_json(F.lit(json.dumps(context))).alias("context"))
    tasks = [
        Task("item", "equals", 3, "input.baz[2]"),
        Task("own", "equals", "${want}", "input.foo"),
        Task("each", "has_length_equal", 5, "responses", item_path="text"),
        Task("gate", "equals", "nope", "input.foo", condition=True),
        Task("after", "equals", "bar", "input.foo", depends_on=("gate",)),
        Task("later", "equals", "bar", "input.foo", depends_on=("after",)),
        Task("sees", "equals", 3, "item", depends_on=("item",)),
    ]
    got = {r["task_id"]: r for r in evaluate.evaluate(df, tasks).collect()}
    assert [got[t]["passed"] for t in ("item", "own", "each", "sees")] == [True] * 4
    assert got["after"]["skipped"] and got["later"]["skipped"] and not got["gate"]["skipped"] and got["later"]["stage"] == 2
    flow = evaluate.workflow_results(evaluate.evaluate(df, tasks)).first()
    assert (flow["total_tasks"], flow["passed_tasks"], flow["pass_rate"]) == (4, 4, 1.0)
    for bad in (
        [Task("a", "equals"), Task("a", "equals")],
        [Task("a", "equals", depends_on=("b",)), Task("b", "equals", depends_on=("a",))],
        [Task("a", "equals", depends_on=("z",))],
    ):
        with pytest.raises(ValueError):
            evaluate.stages(bad)
    for path in ("x" * 600, ".".join("a" * 40), "a[b]"):
        with pytest.raises(ValueError):
            scalars.json_path(path)


def test_response_assertions(spark):
    rows = [("hi", "m", "stop", 3, 4, '{"choices":[{"message":{"role":"assistant"}}]}'), ("", None, None, None, 4, "{}")]
    df = spark.createDataFrame(
        rows,
        "content string, model string, finish_reason string, input_tokens int, output_tokens int, raw string",
    ).withColumn("raw", F.parse_json("raw"))
    e = evaluate
    got = df.select(
        e.response_content(),
        e.response_model(),
        e.response_finish_reason(),
        e.response_input_tokens(),
        e.response_output_tokens(),
        e.response_total_tokens(),
        e.response_field("choices[0].message.role"),
    ).collect()
    assert [tuple(r) for r in got] == [("hi", "m", "stop", 3, 4, 7, '"assistant"'), (None, None, None, None, 4, None, None)]


def test_assertions_see_whole_texts(spark, tmp_path):
    texts = ["a b c d e the", "a b c d e f of\nthe", "a b c d e a", "T T T T T x", "a b c d e"]
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(
        docs,
        "doc_id long, text string, lang string, source string, n_chars long",
    ).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    names = ["E5_E13_whole_lengths", "E6_E7_E8_whole_strings", "E12_whole_collections", "E14_E16_whole_letters"]
    got = {(r["task_id"], r["record_id"]) for n in names for r in registry.QUERIES[n](spark, str(tmp_path)).where("passed").collect()}
    words = [t.replace("\n", " ").split(" ") for t in texts]
    tests = {
        "words5": lambda w: len(w) == 5,
        "few": lambda w: len(w) < 100,
        "some": lambda w: len(w) >= 1,
        "many": lambda w: len(w) > 500,
        "member": lambda w: "the" in w,
        "no_member": lambda w: "the" not in w,
        "any": lambda w: "the" in w or "de" in w,
        "all": lambda w: {"the", "of"} <= set(w),
        "no": lambda w: not {"the", "de"} & set(w),
        "unique": lambda w: len(set(w)) == len(w),
        "each_short": lambda w: all(x.startswith("T") for x in w),
    }
    assert got == {(k, i) for k, f in tests.items() for i, w in enumerate(words) if f(w)}


def test_comparison_flags(spark):
    base = spark.createDataFrame(
        [("r", "a", True), ("r", "b", True), ("s", "a", False), ("only", "a", True)],
        "record_id string, task_id string, passed boolean",
    )
    cand = spark.createDataFrame(
        [("r", "a", False), ("r", "c", True), ("s", "a", True)],
        "record_id string, task_id string, passed boolean",
    )
    got = {r["record_id"]: r for r in compare.compare_records(compare.align_runs(base, cand)).collect()}
    assert set(got) == {"r", "s"} and got["r"]["regressed"] and got["s"]["improved"] and got["r"]["one_sided"] == 2


def test_json_schema_and_fingerprint():
    schema = {
        "properties": {
            "a": {"type": "integer"},
            "b": {"anyOf": [{"type": "number"}, {"type": "null"}]},
            "c": {"type": "array", "items": {"$ref": "#/$defs/N"}},
            "d": {"type": "string", "format": "date-time"},
        },
        "required": ["a"],
        "$defs": {"N": {"type": "object", "properties": {"x": {"type": "boolean"}}}},
    }
    made = tables.struct_of(schema)
    assert made.simpleString() == "struct<a:bigint,b:double,c:array<struct<x:boolean>>,d:timestamp>" and not made["a"].nullable
    turned = {**schema, "properties": dict(reversed(schema["properties"].items()))}
    assert tables.fingerprint(tables.struct_of(turned)) == tables.fingerprint(made)
    for bad in ({"type": "object"}, {"anyOf": [{"type": "string"}, {"type": "integer"}]}):
        with pytest.raises(ValueError):
            tables.struct_of({"properties": {"x": bad}})


def test_dataset_rows_are_checked(spark):
    schema = tables.struct_of({"properties": {"a": {"type": "integer"}, "k": {"enum": ["x", "y"]}}, "required": ["a"]})
    rows = spark.createDataFrame(
        [('{"a":1,"k":"x"}',), ('{"k":"x"}',), ('{"a":1,"k":"z"}',), ("nope",), ('{"a":"text"}',), (None,), ('{"a":2}',)],
        "value string",
    )
    good, bad = tables.parse_dataset(rows, schema)
    assert sorted(r["a"] for r in good.collect()) == [1, 2] and bad.count() == 5


def test_read_only_sql(spark):
    rows, more = tables.query(spark, "SELECT id FROM range(10)", 4)
    assert rows.count() == 4 and more
    for bad in ("DROP TABLE x", "SELECT 1; SELECT 2", "INSERT INTO x SELECT 1"):
        with pytest.raises(ValueError):
            tables.query(spark, bad)


def test_facts_prune_partitions(spark, tmp_path):
    df = spark.range(240).select(
        (F.lit(T0).cast("timestamp") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("created_at"),
        "id",
    )
    tables.write_facts(df, str(tmp_path / "facts"))
    held = tables.read_facts(spark, str(tmp_path / "facts"), datetime(2024, 1, 3), datetime(2024, 1, 4))
    assert sorted(r["id"] for r in held.collect()) == list(range(48, 72))
    assert "PartitionFilters: [" in held._jdf.queryExecution().toString() and "year" in held._jdf.queryExecution().toString().split("PartitionFilters: [")[1].split("]")[0]


def test_stream_matches_batch(spark, tmp_path):
    rows = [("f", T0 + timedelta(minutes=i), float(i)) for i in range(20)]
    spark.createDataFrame(rows, "feature string, created_at timestamp, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("feature string, created_at timestamp, value double").parquet(str(tmp_path / "in"))

    def run(df, name):
        query = df.writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.table(name).collect()

    samples.sample_stream(source, 6, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = samples.read_samples(spark, str(tmp_path / "out"), 6).orderBy("seq").collect()
    assert [(r["seq"], r["value"]) for r in got] == [(0, 2.5), (1, 8.5), (2, 14.5)]
    windows = run(streams.psi_count_windows(source, {"f": [4.0]}, "10 minutes", "1 minute"), "counts")
    assert {(r["bucket"].minute, r["bin_id"], r["bin_count"]) for r in windows} == {(0, 1, 5), (0, 2, 5)}
    assert len(run(streams.dedup_stream(source.unionByName(source), ["created_at"], "created_at"), "dedup")) == 20
    assert len(run(streams.metric_windows(source.withColumnRenamed("feature", "metric"), "10 minutes", "1 minute"), "means")) == 1


def test_outbox_stream_is_safe_to_repeat(spark, tmp_path):
    log = "trace_id string, entity_id string, start_time timestamp, event string"
    for name, rows in (("a", [("t", "e", T0, "candidate"), ("u", "e", T0, "candidate")]), ("b", [("t", "e", T0, "ack")])):
        spark.createDataFrame(rows, log).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        source = spark.readStream.schema(log).parquet(str(tmp_path / "log"))
        outbox.pending_dispatch_stream(source, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert [r["trace_id"] for r in outbox.read_pending(spark, str(tmp_path / "out")).collect()] == ["u"]


def test_scenarios_from_files(spark, tmp_path):
    rows = [{"collection_id": "c", "scenario_id": "1", "query": "q"}, {"collection_id": "d", "scenario_id": "2", "query": "r"}]
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, rows)))
    for form in ("json", "jsonl"):
        assert [r["query"] for r in tables.read_scenarios(spark, str(tmp_path / f"a.{form}"), "d", form).collect()] == ["r"]


def test_plain_strings_are_sought_as_texts(spark):
    words = [["a", "b", "b"], ["c"], [], ["true", True, None, 3, "3"], "a b", None, {"a": 1}, ["\u00e9\"", "a"]]
    rows = spark.createDataFrame([(i, json.dumps({"w": w})) for i, w in enumerate(words)], "record_id int, c string")
    rows = rows.select("record_id", F.parse_json("c").alias("context"))
    sought = [["a", "b"], ["b", "b"], ["true"], ["null"], ["\u00e9\""], ["3"], ["Infinity"], [3, "a"], []]
    actual = evaluate.Value(F.try_variant_get("context", "$.w", "variant"))
    for operator, made in (("contains_all", "array_intersect("), ("contains_any", "arrays_overlap("), ("contains_none", "arrays_overlap(")):
        judged = []
        for x in sought:
            v = F.parse_json(F.lit(json.dumps(x)))
            judged += [F.coalesce(evaluate.OPERATORS[operator](actual, e), F.lit(False)) for e in (evaluate.Value(v, x), evaluate.Value(v))]
        for r in rows.select(*(c.alias(f"c{i}") for i, c in enumerate(judged))).collect():
            assert r[::2] == r[1::2]
        plan = evaluate.evaluate(rows, [Task("t", operator, ["a", "b"], "w")]).select("passed")._jdf.queryExecution().optimizedPlan().toString()
        assert made in plan


def test_span_tree_without_paths_and_services_in_one_aggregation(spark):
    rows = [("t", i, None if i == 0 else (i - 1) // 2, f"svc{i % 3}", T0 + timedelta(seconds=i)) for i in range(9)]
    df = spark.createDataFrame([*rows, ("u", 1, None, None, T0)], "trace_id string, span_id long, parent_span_id long, service_name string, start_time timestamp")
    columns = ["trace_id", "span_id", "depth", "span_order", "root_span_id"]
    want = sorted(map(tuple, traces.span_tree(df).select(columns).collect()))
    for most in (100_000, 3):
        got = traces.span_tree(df, most, paths=False)
        assert got.columns == columns and sorted(map(tuple, got.collect())) == want
    made = evaluate.trace_values(df, {"services": ("trace_service_count",)})
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, made.collect())) == [("t", 3), ("u", 0)]


def test_synth_records_make_the_log_once(spark, sf):
    made = registry.QUERIES["T14_synth_records"](spark, sf)
    assert "l_orderkey" not in made._jdf.queryExecution().optimizedPlan().toString()  # only the written log is read


def test_spans_of_large_tables_make_more_partitions(spark, sf, monkeypatch):
    """What a task holds of the spans stays about the same as line items grow; the rows stay the same."""
    plain = views.spans(spark, sf).drop("attributes", "events")
    few = plain.rdd.getNumPartitions()
    monkeypatch.setattr(views, "DEALT_ROWS", 400)
    many = views.spans(spark, sf).drop("attributes", "events")
    assert few <= 4 and many.rdd.getNumPartitions() >= 12
    assert plain.exceptAll(many).isEmpty() and many.exceptAll(plain).isEmpty()
