"""Evaluation and comparison queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinwatch.operators import compare, evaluate, traces
from skeinwatch.operators.evaluate import Task
from skeinwatch.operators.profile import histogram
from skeinwatch.plans import views
from skeinwatch.plans.book import Book, rounded, stamp
from skeinwatch.plans.views import with_views

BOOK = Book()
query = BOOK.query
_R = with_views("recs")

#: Task and the SQL predicate that is true exactly when it passes.
TASKS: dict[str, list[tuple[Task, str]]] = {
    "E3_equality": [
        (Task("lang_en", "equals", "en", "lang"), "lang = 'en'"),
        (Task("not_de", "not_equal", "de", "lang"), "lang IS DISTINCT FROM 'de'"),
        (Task("quality_one", "equals", 1.0, "quality"), "coalesce(quality = 1, false)"),
        (Task("quality_text", "equals", "1", "quality"), "coalesce(quality = 1, false)"),
        (Task("own", "equals", "${lang}", "lang"), "true"),
    ],
    "E4_E11_numbers": [
        (Task("gt", "greater_than", 1000, "n_chars"), "n_chars > 1000"),
        (Task("ge", "greater_than_or_equal", 1000, "n_chars"), "n_chars >= 1000"),
        (Task("lt", "less_than", 500.5, "n_chars"), "n_chars < 500.5"),
        (Task("le", "less_than_or_equal", 500, "n_chars"), "n_chars <= 500"),
        (Task("in", "in_range", [100, 900], "n_chars"), "n_chars BETWEEN 100 AND 900"),
        (Task("out", "not_in_range", [100, 900], "n_chars"), "n_chars NOT BETWEEN 100 AND 900"),
        (Task("pos", "is_positive", None, "quality"), "coalesce(quality > 0, false)"),
        (Task("zero", "is_zero", None, "quality"), "coalesce(quality = 0, false)"),
        (Task("neg", "is_negative", None, "n_chars"), "n_chars < 0"),
        (Task("text_gt", "greater_than", 1, "lang"), "false"),
        (Task("about", "approximately_equals", [500, 100], "n_chars"), "abs(n_chars - 500) <= 100"),
    ],
    "E5_E13_lengths": [
        (Task("lang2", "has_length_equal", 2, "lang"), "length(lang) = 2"),
        (Task("src", "has_length_greater_than", 4, "source"), "length(source) > 4"),
        (Task("words5", "has_length_equal", 5, "words"), "len(words) = 5"),
        (Task("few", "has_length_less_than", 5, "words"), "len(words) < 5"),
        (Task("some", "has_length_greater_than_or_equal", 1, "words"), "len(words) >= 1"),
        (Task("at_most", "has_length_less_than_or_equal", 4, "source"), "length(source) <= 4"),
        (Task("meta2", "has_length_equal", 2, "meta"), "true"),
        (Task("full", "is_not_empty", None, "source"), "length(source) > 0"),
        (Task("none", "is_empty", None, "quality"), "quality IS NULL"),
    ],
    "E6_E7_E8_strings": [
        (Task("has", "contains", "rc1", "source"), "contains(source, 'rc1')"),
        (Task("has_not", "not_contains", "rc1", "source"), "NOT contains(source, 'rc1')"),
        (Task("starts", "starts_with", "src1", "source"), "starts_with(source, 'src1')"),
        (Task("ends", "ends_with", "7", "source"), "ends_with(source, '7')"),
        (Task("word", "contains_word", "src1", "source"), "source = 'src1'"),
        (Task("regex", "matches_regex", "^src[0-4]$", "source"), "regexp_matches(source, '^src[0-4]$')"),
        (Task("member", "contains", "the", "words"), "list_contains(words, 'the')"),
    ],
    "E9_E10_types": [
        (Task("num", "is_numeric", None, "n_chars"), "true"),
        (Task("str", "is_string", None, "lang"), "true"),
        (Task("bool", "is_boolean", None, "meta.flag"), "true"),
        (Task("null", "is_null", None, "quality"), "quality IS NULL"),
        (Task("arr", "is_array", None, "words"), "true"),
        (Task("obj", "is_object", None, "meta"), "true"),
        (Task("mail", "is_email", None, "source"), "false"),
        (Task("url", "is_url", None, "source"), "false"),
        (Task("uuid", "is_uuid", None, "source"), "false"),
        (Task("iso", "is_iso8601", None, "source"), "false"),
        (Task("json", "is_json", None, "lang"), "false"),
    ],
    "E12_collections": [
        (Task("any", "contains_any", ["the", "de"], "words"), "list_has_any(words, ['the', 'de'])"),
        (Task("all", "contains_all", ["the", "of"], "words"), "list_has_all(words, ['the', 'of'])"),
        (Task("no", "contains_none", ["the", "de"], "words"), "NOT list_has_any(words, ['the', 'de'])"),
        (Task("unique", "has_unique_items", None, "words"), "len(list_distinct(words)) = len(words)"),
        (Task("keyword", "contains_any", ["c1", "c2"], "source"), "contains(source, 'c1') OR contains(source, 'c2')"),
    ],
    "E14_E16_letters": [
        (Task("alpha", "is_alphabetic", None, "lang"), "true"),
        (Task("alnum", "is_alphanumeric", None, "source"), "true"),
        (Task("lower", "is_lowercase", None, "lang"), "true"),
        (Task("upper", "is_uppercase", None, "lang"), "false"),
        (Task("each", "contains", "e", "words"), "false"),
        (Task("each_short", "starts_with", "T", "words"), "len(list_filter(words, lambda w: NOT starts_with(w, 'T'))) = 0"),
    ],
}


def _sql(tasks) -> str:
    return _R + " " + " UNION ALL ".join(
        f"SELECT record_id, '{t.id}' AS task_id, coalesce({p}, false) AS passed FROM recs" for t,
        p in tasks
    )


def _add(name, tasks):
    @query(name, _sql(tasks))
    def run(spark, sf):
        return evaluate.evaluate(views.records(spark, sf), [t for t, _ in tasks]).select("record_id", "task_id", "passed")


for _name, _tasks in TASKS.items():
    _add(_name, [(t, p) for t, p in _tasks if t.id != "each"])

#: Text, and whether it is an e-mail address, a URL, a UUID, an ISO 8601 time, alphabetic, alphanumeric, in lower and in upper case.
FORMS = [
    ("http://x", "01000010"),
    ("https://-bad_host!/", "00000010"),
    ("https://a-b.example.org/p?q", "01000010"),
    ("x@y.org", "10000010"),
    ("x@y.org\n", "00000010"),
    ("2024-01-05T10:00:00+0100", "00000001"),
    ("2024-01-05T10:00:00+01:00", "00010001"),
    ("2024-01-05", "00010000"),
    ("2024-01-05\n", "00000000"),
    ("abc", "00001110"),
    ("abc\n", "00000010"),
    ("ABC1", "00000101"),
    ("\u4e2d\u6587", "00001100"),
    ("\u00e9t\u00e9", "00001110"),
    ("", "00001100"),
    ("123e4567-e89b-12d3-a456-426614174000", "00100010"),
    ("123e4567-e89b-12d3-a456-426614174000\n", "00000010"),
    ("ftp://x.org", "00000010"),
]
_FORM_TASKS = ("is_email", "is_url", "is_uuid", "is_iso8601", "is_alphabetic", "is_alphanumeric", "is_lowercase", "is_uppercase")


def _form_sql() -> str:
    rows = " ".join(f"WHEN {i} THEN '{bits}'" for i, (_, bits) in enumerate(FORMS))
    pick = " UNION ALL ".join(
        f"SELECT record_id, '{task}' AS task_id, bits[{i + 1}] = '1' AS passed FROM f" for i,
        task in enumerate(_FORM_TASKS)
    )
    return f"WITH f AS (SELECT doc_id AS record_id, CASE doc_id % {len(FORMS)} {rows} END AS bits FROM documents) {pick}"


@query("E10_E14_E16_forms", _form_sql())
def forms(spark, sf):
    """Format and letter checks on texts that come near a format, dealt to the documents."""
    text = F.element_at(F.array(*(F.lit(t) for t, _ in FORMS)), (F.col("doc_id") % len(FORMS) + 1).cast("int"))
    held = views.table(spark, sf, "documents").select(
        F.col("doc_id").alias("record_id"),
        F.to_variant_object(F.struct(text.alias("text"))).alias("context"),
    )
    return evaluate.evaluate(held, [Task(t, t, None, "text") for t in _FORM_TASKS]).select("record_id", "task_id", "passed")


#: The tasks on words again, with limits that fit whole texts.
WHOLE: dict[str, list[tuple[Task, str]]] = {
    "E5_E13_whole_lengths": [
        (Task("words5", "has_length_equal", 5, "words"), "len(words) = 5"),
        (Task("few", "has_length_less_than", 100, "words"), "len(words) < 100"),
        (Task("some", "has_length_greater_than_or_equal", 1, "words"), "len(words) >= 1"),
        (Task("many", "has_length_greater_than", 500, "words"), "len(words) > 500"),
    ],
    "E6_E7_E8_whole_strings": [
        (Task("member", "contains", "the", "words"), "list_contains(words, 'the')"),
        (Task("no_member", "not_contains", "the", "words"), "NOT list_contains(words, 'the')"),
    ],
    "E12_whole_collections": [
        (Task("any", "contains_any", ["the", "de"], "words"), "list_has_any(words, ['the', 'de'])"),
        (Task("all", "contains_all", ["the", "of"], "words"), "list_has_all(words, ['the', 'of'])"),
        (Task("no", "contains_none", ["the", "de"], "words"), "NOT list_has_any(words, ['the', 'de'])"),
        (Task("unique", "has_unique_items", None, "words"), "len(list_distinct(words)) = len(words)"),
    ],
    "E14_E16_whole_letters": [
        (Task("each_short", "starts_with", "T", "words"), "len(list_filter(words, lambda w: NOT starts_with(w, 'T'))) = 0")
    ],
}


def _add_whole(name, tasks):
    @query(
        name,
        with_views("whole_recs") + " " + " UNION ALL ".join(
            f"SELECT record_id, '{t.id}' AS task_id, coalesce({p}, false) AS passed FROM whole_recs" for t,
            p in tasks
        ),
    )
    def run(spark, sf):
        return evaluate.evaluate(views.records(spark, sf), [t for t, _ in tasks]).select("record_id", "task_id", "passed")


for _name, _tasks in WHOLE.items():
    _add_whole(_name, _tasks)

GATED = [
    Task("en", "equals", "en", "lang", condition=True),
    Task("long", "greater_than", 800, "n_chars", depends_on=("en",)),
    Task("good", "equals", 1, "quality"),
    Task("len2", "has_length_equal", 2, "en", depends_on=("en",)),
]


@query("E1_E2_E18_gated", f"""{_R} SELECT record_id, 'en' AS task_id, false AS skipped, coalesce(lang = 'en', false) AS passed FROM recs
  UNION ALL SELECT record_id, 'long', NOT coalesce(lang = 'en', false), coalesce(lang = 'en' AND n_chars > 800, false) FROM recs
UNION ALL SELECT record_id, 'good', false, coalesce(quality = 1, false) FROM recs UNION ALL
  SELECT record_id, 'len2', NOT coalesce(lang = 'en', false), coalesce(lang = 'en', false) FROM recs""")
def gated(spark, sf):
    return evaluate.evaluate(views.records(spark, sf), GATED).select("record_id", "task_id", "skipped", "passed")


_FLOW = f"""{_R}, counts AS (SELECT record_id, coalesce(lang = 'en', false) AS en, coalesce(n_chars > 800, false)::INTEGER AS a,
  coalesce(quality = 1, false)::INTEGER AS b FROM recs),
flow AS (SELECT record_id, CASE WHEN en THEN 3 ELSE 1 END AS total_tasks, CASE WHEN en THEN a + b + 1 ELSE b END AS passed_tasks FROM counts)"""


@query("E19_workflow_results", f"""{_FLOW} SELECT record_id, total_tasks::BIGINT AS total_tasks, passed_tasks::BIGINT AS passed_tasks,
  (total_tasks - passed_tasks)::BIGINT AS failed_tasks, round(passed_tasks / total_tasks, 6) AS pass_rate FROM flow""")
def workflow_results(spark, sf):
    return rounded(evaluate.workflow_results(evaluate.evaluate(views.records(spark, sf), GATED)))


@query("E32_result_rows", f"""{_FLOW} SELECT record_id, t AS task_id, round(passed_tasks / total_tasks, 6) AS pass_rate
  FROM flow, (VALUES ('en'), ('long'), ('good'), ('len2')) v(t)""")
def result_rows(spark, sf):
    return rounded(evaluate.result_rows(evaluate.evaluate(views.records(spark, sf), GATED)).select("record_id", "task_id", "pass_rate"))


@query("E31_result_matrix", f"""{_R} SELECT record_id, coalesce(lang = 'en', false)::INTEGER AS en, coalesce(lang = 'en' AND n_chars > 800, false)::INTEGER AS long,
  coalesce(quality = 1, false)::INTEGER AS good, coalesce(lang = 'en', false)::INTEGER AS len2 FROM recs""")
def result_matrix(spark, sf):
    return evaluate.result_matrix(evaluate.evaluate(views.records(spark, sf), GATED), ["en", "long", "good", "len2"])


@query("E31_embedding_matrix", f"""{_R}, e AS (SELECT vec_id, embedding::DOUBLE[] AS a, list_reverse(embedding)::DOUBLE[] AS b FROM embeddings)
  SELECT record_id, coalesce(lang = 'en', false)::INTEGER AS en, round(list_sum(a) / len(a), 6) AS a_mean, round(list_sum(b) / len(b), 6) AS b_mean,
  round(list_cosine_similarity(a, b), 6) AS a_b_cosine, round(list_cosine_similarity(a, b), 6) AS b_a_cosine FROM recs LEFT JOIN e ON vec_id = record_id""")
def embedding_matrix(spark, sf):
    """The result matrix with two embeddings a record: a vector and the same one backwards."""
    held = views.table(spark, sf, "embeddings").select(F.col("vec_id").alias("record_id"), F.col("embedding").alias("a"), F.reverse("embedding").alias("b"))
    return rounded(evaluate.result_matrix(evaluate.evaluate(views.records(spark, sf), GATED), ["en"], embeddings=held, targets=["a", "b"]))


@query("E33_score_histograms", f"""{_R}, m AS (SELECT coalesce(lang = 'en', false)::INTEGER AS en, coalesce(quality = 1, false)::INTEGER AS good FROM recs)
  SELECT f AS feature, b::INTEGER AS bin, (b * 0.25)::DOUBLE AS left_edge, CASE b WHEN 0 THEN z WHEN 3 THEN o ELSE 0 END::BIGINT AS count
  FROM (SELECT 'en' AS f, count(*) FILTER (en = 0) AS z, count(*) FILTER (en = 1) AS o FROM m UNION ALL
  SELECT 'good', count(*) FILTER (good = 0), count(*) FILTER (good = 1) FROM m), range(4) r(b)""")
def score_histograms(spark, sf):
    return rounded(histogram(evaluate.result_matrix(evaluate.evaluate(views.records(spark, sf), GATED), ["en", "good"]), ["en", "good"], 4))


_TREE = with_views("ranked", "spans").replace("WITH ", "WITH RECURSIVE ", 1) + """, depths AS (SELECT trace_id, span_id, 0 AS depth
  FROM spans WHERE parent_span_id IS NULL UNION ALL SELECT s.trace_id, s.span_id, d.depth + 1 FROM spans s
  JOIN depths d ON s.trace_id = d.trace_id AND s.parent_span_id = d.span_id)"""


@query("E20_E25_trace_values", f"""{_TREE} SELECT s.trace_id, count(*) FILTER (span_name = 'op1') AS op1, bool_or(flag = 'R') AS returned,
  round(sum(qty) FILTER (span_name = 'op2'), 6)::DOUBLE AS op2_qty, round(avg(qty), 6) AS mean_qty, count(*) AS span_count,
  count(*) FILTER (status_code = 2) AS errors, count(DISTINCT service_name) AS services,
  max(depth) AS max_depth, (epoch_ms(max(end_time)) - epoch_ms(min(start_time)))::BIGINT AS duration,
    max(flag) FILTER (rk = 1) AS root_flag, bool_or(span_name = 'op1') AND bool_or(span_name = 'op2') AS both FROM spans s
    JOIN depths d ON s.trace_id = d.trace_id AND s.span_id = d.span_id GROUP BY s.trace_id""")
def trace_values(spark, sf):
    spans = views.spans(spark, sf)
    held = spans.join(traces.span_tree(spans, paths=False).select("trace_id", "span_id", "depth", "span_order"), ["trace_id", "span_id"])
    asked = {
        "op1": ("span_count", {"name": "op1"}),
        "returned": ("span_exists", {"attribute": ("flag", "R")}),
        "op2_qty": ("span_aggregation", {"name": "op2"}, "qty", "sum"),
        "mean_qty": ("span_aggregation", {"has_attribute": "qty"}, "qty", "average"),
        "span_count": ("trace_span_count",),
        "errors": ("trace_error_count",),
        "services": ("trace_service_count",),
        "max_depth": ("trace_max_depth",),
        "duration": ("trace_duration",),
        "root_flag": ("trace_attribute", "flag"),
        "both": ("span_set", ["op1", "op2"]),
    }
    return rounded(evaluate.trace_values(held, asked))


@query("E20_E22_E23_E24_span_values", f"""{with_views('ranked', 'spans')} SELECT trace_id, list(span_name
  ORDER BY rk) = ['op1', 'op2'] AS exactly, len(list_filter(range(1, count(*)), lambda i: list(span_name
  ORDER BY rk)[i] = 'op1' AND list(span_name ORDER BY rk)[i + 1] = 'op2'))::INTEGER AS in_a_row,
  CASE count(*) FILTER (span_name = 'op3')
    WHEN 1 THEN '["' || max(qty) FILTER (span_name = 'op3') || '"]' ELSE '[' || coalesce(string_agg('"' || qty || '"', ','
    ORDER BY rk) FILTER (span_name = 'op3'), '') || ']' END AS op3_qty,
  '[' || coalesce(string_agg(duration_ms::VARCHAR, ','
    ORDER BY rk) FILTER (flag = 'R'), '') || ']' AS durations, count(*) FILTER (span_name = 'op4') AS n4,
    min(qty::DOUBLE) FILTER (span_name = 'op4') AS lo4, max(qty::DOUBLE) FILTER (span_name = 'op4') AS hi4,
  arg_min(qty::DOUBLE, rk) FILTER (span_name = 'op4') AS first4, arg_max(qty::DOUBLE, rk) FILTER (span_name = 'op4') AS last4 FROM spans
    GROUP BY trace_id""")
def span_values(spark, sf):
    asked = {
        "exactly": ("span_sequence", ["op1", "op2"]),
        "in_a_row": ("sequence_count", ["op1", "op2"]),
        "op3_qty": ("span_attribute", {"name": "op3"}, "qty"),
        "durations": ("span_duration", {"attribute": ("flag", "R")}),
        **{
            name: ("span_aggregation", {"name": "op4"}, "qty", f) for name,
            f in (("n4", "count"), ("lo4", "min"), ("hi4", "max"), ("first4", "first"), ("last4", "last"))
        },
    }
    return rounded(evaluate.trace_values(views.spans(spark, sf).withColumn("span_order", F.col("rk")), asked))


@query("E21_span_filter", f"""{with_views('ranked', 'spans')} SELECT span_id FROM spans
  WHERE (span_name = 'op1' OR regexp_matches(span_name,
  '[34]$')) AND status_code = 2 AND duration_ms BETWEEN 5000 AND 20000 AND flag IS NOT NULL""")
def span_filter(spark, sf):
    wanted = {
        "and": [{"or": [{"name": "op1"}, {"name_regex": "[34]$"}]}, {"status": 2}, {"duration": (5000, 20000)}, {"has_attribute": "flag"}]
    }
    return views.spans(spark, sf).where(evaluate.span_filter(wanted)).select("span_id")


@query(
    "E26_attribute_filter",
    f"{with_views('ranked', 'spans')} SELECT trace_id, bool_or(qty > 40) AS any_big, bool_and(qty > 5) AS all_big FROM spans GROUP BY trace_id",
)
def attribute_filter(spark, sf):
    big = lambda n: Task("big", "greater_than", n)
    return evaluate.trace_values(
        views.spans(spark, sf),
        {"any_big": ("attribute_filter", "qty", big(40), "any"), "all_big": ("attribute_filter", "qty", big(5), "all")},
    )


def _calls(spark, sf):
    """A conversation's turns as tool calls."""
    c = views.table(spark, sf, "conversations")
    call = F.struct(
        F.col("turn").alias("o"),
        F.col("role").alias("name"),
        F.parse_json(
            F.to_json(F.struct(F.length("text").alias("n"), F.struct((F.col("turn") % 2).alias("odd")).alias("meta")))
        ).alias("arguments"),
        F.parse_json(F.to_json(F.struct(F.col("turn").alias("turn")))).alias("result"),
    )
    rows = c.select(
        "conv_id",
        F.col("turn").alias("t"),
        call["name"].alias("name"),
        F.to_json(call["arguments"]).alias("a"),
        F.to_json(call["result"]).alias("r"),
    )
    held = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("t", "name", "a", "r"))).alias("c"))
    return held.select(
        "conv_id",
        F.transform(
            "c",
            lambda x: F.struct(x["name"].alias("name"), F.parse_json(x["a"]).alias("arguments"), F.parse_json(x["r"]).alias("result")),
        ).alias("tool_calls"),
    )


@query("E27_E28_tool_calls", """WITH c AS (SELECT conv_id, list(role
  ORDER BY turn) AS names, bool_or(role = 'assistant' AND turn % 2 = 1) AS odd, arg_min(length(text), turn) FILTER (role = 'user') AS n,
  arg_min(turn, turn) FILTER (role = 'assistant') AS t FROM conversations GROUP BY conv_id)
SELECT conv_id, list_contains(names, 'system') AS called, NOT list_contains(names, 'system') AS not_called, coalesce(odd,
  false) AS with_args, len(list_filter(names, lambda x: x = 'user'))::INTEGER AS calls, regexp_matches(array_to_string(names, ','),
  'user.*assistant.*user') AS seq, n::VARCHAR AS argument, CASE WHEN t IS NOT NULL THEN '{"turn":' || t || '}' END AS result FROM c""")
def tool_calls(spark, sf):
    e = evaluate
    return _calls(spark, sf).select(
        "conv_id",
        e.tool_called("system").alias("called"),
        e.tool_not_called("system").alias("not_called"),
        e.tool_called("assistant", {"meta": {"odd": 1}}).alias("with_args"),
        e.tool_call_count("user").alias("calls"),
        e.tool_call_sequence(["user", "assistant", "user"]).alias("seq"),
        e.tool_argument("user", "n").alias("argument"),
        e.tool_result("assistant").alias("result"),
    )


def _responses(spark, sf):
    """A conversation's turns as model responses."""
    c = views.table(spark, sf, "conversations")
    model, reason = F.concat(F.lit("model"), F.col("conv_id") % 3), F.when(F.col("turn") % 4 == 3, "length").otherwise("stop")
    raw = F.struct(
        F.array(F.struct(reason.alias("finish_reason"), F.struct("role", F.col("text").alias("content")).alias("message"))).alias("choices")
    )
    return c.select(
        "conv_id",
        "turn",
        F.col("text").alias("content"),
        model.alias("model"),
        reason.alias("finish_reason"),
        F.size(F.split("text", " ")).alias("input_tokens"),
        F.length("text").alias("output_tokens"),
        F.parse_json(F.to_json(raw)).alias("raw"),
    )


@query("E28_response_assertions", """SELECT conv_id, turn, nullif(text, '') AS content, 'model' || (conv_id % 3) AS model, CASE
  WHEN turn % 4 = 3 THEN 'length' ELSE 'stop' END AS finish_reason, len(string_split(text, ' '))::BIGINT AS input_tokens,
  length(text)::BIGINT AS output_tokens,
  (len(string_split(text, ' ')) + length(text))::BIGINT AS total_tokens, '"' || role || '"' AS field FROM conversations""")
def response_assertions(spark, sf):
    e = evaluate
    return _responses(spark, sf).select(
        "conv_id",
        "turn",
        e.response_content().alias("content"),
        e.response_model().alias("model"),
        e.response_finish_reason().alias("finish_reason"),
        e.response_input_tokens().alias("input_tokens"),
        e.response_output_tokens().alias("output_tokens"),
        e.response_total_tokens().alias("total_tokens"),
        e.response_field("choices[0].message.role").alias("field"),
    )


@query(
    "E29_judge_scores",
    "SELECT d.doc_id AS record_id, coalesce(l.quality >= 1, false) AS passed FROM documents d LEFT JOIN labels l USING (doc_id)",
)
def judge_scores(spark, sf):
    scores = views.table(spark, sf, "labels").select(
        F.col("doc_id").alias("record_id"),
        F.lit("judge").alias("task_id"),
        F.col("quality").cast("double").alias("score"),
    )
    return evaluate.evaluate(
        views.records(spark, sf),
        [Task("judge", "greater_than_or_equal", 1, kind="judge")],
        judge_scores=scores,
    ).select("record_id", "passed")


@query("E30_embedding_scores", """WITH e AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b FROM embeddings a
  JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(list_avg(a), 5) AS a_mean, round(list_avg(b), 5) AS b_mean, round(list_cosine_similarity(a, b), 5) AS a_b_cosine,
  round(list_cosine_similarity(b, a), 5) AS b_a_cosine FROM e""")
def embedding_scores(spark, sf):
    e = views.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    return rounded(evaluate.embedding_scores(pairs, ["a", "b"]).drop("a", "b"), 5)


def _run(spark, sf, limit, extra=False):
    tasks = [
        Task("long", "greater_than", limit, "n_chars"),
        Task("good", "equals", 1, "quality"),
        Task("only_cand" if extra else "only_base", "equals", "en", "lang"),
    ]
    return evaluate.evaluate(views.records(spark, sf), tasks).select("record_id", "task_id", "passed")


_ALIGNED = f"""{_R}, al AS (SELECT record_id, 'long' AS task_id, n_chars > 500 AS b, n_chars > 800 AS c FROM recs UNION ALL
  SELECT record_id, 'good', coalesce(quality = 1, false), coalesce(quality = 1, false) FROM recs),
  rec AS (SELECT record_id, avg(b::INTEGER) AS base_rate, avg(c::INTEGER) AS cand_rate, count(*) FILTER (b <> c) AS changed FROM al
  GROUP BY record_id)"""


@query("J12_E34_compare_records", f"""{_ALIGNED} SELECT record_id, base_rate, cand_rate, changed, 2::BIGINT AS one_sided, cand_rate - base_rate AS delta,
  cand_rate - base_rate < -0.05 AS regressed, cand_rate - base_rate > 0.01 AS improved FROM rec""")
def compare_records(spark, sf):
    return compare.compare_records(compare.align_runs(_run(spark, sf, 500), _run(spark, sf, 800, True)))


@query("E34_compare_results", f"""{_ALIGNED} SELECT count(*) AS records, count(*) FILTER (cand_rate - base_rate < -0.05) AS regressed, 0::BIGINT AS improved,
  count(*) FILTER (cand_rate = base_rate) AS unchanged, round(avg(base_rate), 6) AS base_rate, round(avg(cand_rate), 6) AS cand_rate,
  round(avg(cand_rate - base_rate), 6) AS mean_delta FROM rec""")
def compare_results(spark, sf):
    return rounded(compare.compare_results(_run(spark, sf, 500), _run(spark, sf, 800, True)))


@query("E35_task_aggregate", f"""{_ALIGNED} SELECT task_id, count(*) AS matched, round(avg(b::INTEGER), 6) AS base_rate, round(avg(c::INTEGER), 6) AS cand_rate,
  count(*) FILTER (NOT b AND c) AS fixed, count(*) FILTER (b AND NOT c) AS broken FROM al GROUP BY task_id""")
def task_aggregate(spark, sf):
    return rounded(compare.task_aggregate(compare.align_runs(_run(spark, sf, 500), _run(spark, sf, 800, True))))


@query("E36_scenario_metrics", f"""{_R}, f AS (SELECT lang AS alias, (coalesce(quality = 1, false)::INTEGER + (n_chars > 800)::INTEGER) / 2 AS r, n_chars > 800 AS p
  FROM recs), d AS (SELECT avg(r) AS r FROM f GROUP BY alias), x AS (SELECT r, 'd' AS k FROM d UNION ALL SELECT avg(p::INTEGER), 's' FROM f
  UNION ALL SELECT avg(r), 'w' FROM f)
  SELECT round(avg(r) FILTER (k = 'd'), 6) AS dataset_rate, round(avg(r) FILTER (k = 's'), 6) AS scenario_rate,
  round(avg(r) FILTER (k = 'w'), 6) AS workflow_rate, round(avg(r), 6) AS overall_rate FROM x""")
def scenario_metrics(spark, sf):
    tasks = [Task("long", "greater_than", 800, "n_chars"), Task("good", "equals", 1, "quality")]
    records = views.records(spark, sf)
    rows = evaluate.evaluate(records, tasks)
    flows = evaluate.workflow_results(rows).join(records.select("record_id", F.col("lang").alias("alias")), "record_id")
    return rounded(
        compare.scenario_metrics(flows, rows.where("task_id = 'long'").select(F.col("record_id").alias("scenario_id"), "passed"))
    )


@query("E37_compare_scenarios", f"""{_ALIGNED}, j AS (SELECT lang AS alias, base_rate, cand_rate FROM rec JOIN recs USING (record_id))
  SELECT alias, round(avg(base_rate), 6) AS base_rate, round(avg(cand_rate), 6) AS cand_rate, round(avg(cand_rate - base_rate), 6) AS delta,
  CASE WHEN avg(cand_rate - base_rate) < -0.05 THEN 'regressed' ELSE 'compared' END AS status FROM j WHERE alias NOT IN ('de', 'fr')
  GROUP BY alias UNION ALL SELECT 'de', NULL, NULL, NULL, 'new' UNION ALL SELECT 'fr', NULL, NULL, NULL, 'removed'""")
def compare_scenarios(spark, sf):
    of = views.records(spark, sf).select("record_id", F.col("lang").alias("alias"))
    return rounded(
        compare.compare_scenarios(
            _run(spark, sf, 500).join(of.where("alias <> 'de'"), "record_id"),
            _run(spark, sf, 800, True).join(of.where("alias <> 'fr'"), "record_id"),
        )
    )


@query("E38_assign_scenarios", "SELECT doc_id AS record_id, 's' || (doc_id % 5) AS scenario_id FROM documents WHERE doc_id % 3 > 0")
def assign_scenarios(spark, sf):
    tag = F.concat(F.lit(compare.SCENARIO_TAG), F.lit("s"), F.col("doc_id") % 5)
    held = views.table(spark, sf, "documents").select(
        F.col("doc_id").alias("record_id"),
        F.when(F.col("doc_id") % 3 > 0, F.array(F.lit("x=y"), tag)).otherwise(F.array(F.lit("x=y"))).alias("tags"),
    )
    return compare.assign_scenarios(held).drop("tags")


@query(
    "E40_pending_records",
    "SELECT event_id FROM events WHERE event_type = 'view' AND ts <= TIMESTAMP '2024-01-05' AND (props::JSON->>'k')::INTEGER % 5 < 3",
)
def pending_records(spark, sf):
    from datetime import datetime

    held = views.metric(spark, sf).select(
        "event_id",
        F.when(F.col("metric") == "view", "pending").otherwise("done").alias("status"),
        F.col("created_at").alias("scheduled_at"),
        (F.col("k") % 5).alias("retry_count"),
    )
    return compare.pending_records(held, datetime(2024, 1, 5)).select("event_id")


@query("E40_list_records", f"""SELECT event_id, {stamp("ts", "created_at")} FROM events
  WHERE user_id % 5 = 2 AND event_type = 'view' AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-25'
  AND (ts, event_id) < (TIMESTAMP '2024-01-22', 5) ORDER BY events.ts DESC, event_id DESC LIMIT 26""")
def list_records(spark, sf):
    from datetime import datetime

    held = views.metric(spark, sf).select(
        F.col("event_id").alias("record_id"),
        (F.col("user_id") % 5).alias("entity_id"),
        F.col("metric").alias("status"),
        "created_at",
    )
    page = compare.list_records(
        held,
        25,
        [datetime(2024, 1, 22), 5],
        entity_id=2,
        status="view",
        start=datetime(2024, 1, 3),
        end=datetime(2024, 1, 25),
    )
    return rounded(page.select(F.col("record_id").alias("event_id"), "created_at"))


@query("J14_join_eval_inputs", f"""{with_views('ranked', 'spans')}, n AS (SELECT trace_id, count(*) AS c FROM spans WHERE service_name = 'svc1' GROUP BY trace_id)
  SELECT o_orderkey AS trace_id, o_custkey % 5 AS entity_id, 'profile' || (o_custkey % 5) AS profile, coalesce(c, 0) AS span_count, CASE
  WHEN c IS NOT NULL THEN 'ready' ELSE 'retry' END AS status FROM orders LEFT JOIN n ON o_orderkey = trace_id WHERE o_custkey % 5 < 3""")
def join_eval_inputs(spark, sf):
    records = views.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("trace_id"),
        (F.col("o_custkey") % 5).alias("entity_id"),
        F.lit(0).alias("retry_count"),
    )
    profiles = spark.range(3).select(F.col("id").alias("entity_id"), F.concat(F.lit("profile"), "id").alias("profile"))
    return compare.join_eval_inputs(records, profiles, views.spans(spark, sf).where("service_name = 'svc1'")).drop("retry_count")


@query("E41_J14_attach_spans", f"""{with_views('ranked', 'spans')}, n AS (SELECT trace_id, count(*) AS c FROM spans WHERE service_name = 'svc1' GROUP BY trace_id)
  SELECT o_orderkey AS trace_id, coalesce(c, 0) AS span_count, CASE WHEN c IS NOT NULL THEN 'ready'
  WHEN o_orderkey % 4 + 1 >= 3 THEN 'failed' ELSE 'retry' END AS status, (CASE
  WHEN c IS NULL THEN o_orderkey % 4 + 1 ELSE o_orderkey % 4 END)::BIGINT AS retry_count FROM orders LEFT JOIN n ON o_orderkey = trace_id""")
def attach_spans(spark, sf):
    records = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("trace_id"), (F.col("o_orderkey") % 4).alias("retry_count"))
    return compare.attach_spans(records, views.spans(spark, sf).where("service_name = 'svc1'"))
