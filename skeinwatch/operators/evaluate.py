"""Assertions over JSON records, traces, tool calls and responses, as column expressions.

A task resolves a path in a record's context (a variant), compares it with an expected value by an operator, and gives a
row: passed, actual, expected, error. Tasks run in stages of their dependencies; a task whose conditional dependency
failed or was skipped is skipped. The list of tasks is configuration on the driver and never touches rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwatch.functions.scalars import UUID, anchored, cosine, json_path


@dataclass(frozen=True)
class Task:
    id: str
    operator: str
    expected: object = None
    path: str | None = None
    item_path: str | None = None
    condition: bool = False
    depends_on: tuple[str, ...] = ()
    kind: str = "assertion"
    description: str = field(default="", compare=False)


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


class Value:
    """A variant seen through its JSON type; every accessor is null where the type differs. literal: its value, if it is fixed."""

    def __init__(self, v: Column, literal: object = None):
        self.v, self.literal = v, literal
        self.kind = F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
        self.is_null = v.isNull() | (self.kind == "VOID")
        self.is_string, self.is_boolean = self.kind == "STRING", self.kind == "BOOLEAN"
        self.is_array, self.is_object = self.kind.startswith("ARRAY"), self.kind.startswith("OBJECT")
        self.is_number = self.kind.isin("BIGINT", "DOUBLE", "FLOAT") | self.kind.startswith("DECIMAL")
        self.text = F.when(self.is_string, _get(v, "$", "string"))
        self.number = F.when(self.is_number, _get(v, "$", "double"))
        self.items = F.when(self.is_array, _get(v, "$", "array<variant>"))
        self.length = F.when(self.is_string, F.char_length(self.text)).when(self.is_array, F.size(self.items)).when(
            self.is_object,
            F.size(_get(v, "$", "map<string,variant>")),
        )
        self.json = F.when(self.is_null, F.lit("null")).otherwise(F.to_json(v))

    @property
    def loose_number(self) -> Column:
        """A number, or a string that reads as one."""
        return F.coalesce(self.number, self.text.try_cast("double"))


def same(a: Value, b: Value) -> Column:
    """Equality with numbers normalised: 300 is 300.0, and "3" is 3."""
    numeric = (a.is_number | b.is_number) & a.loose_number.isNotNull() & b.loose_number.isNotNull()
    return F.when(numeric, a.loose_number == b.loose_number).otherwise(a.json == b.json)


def _member(items: Column, wanted: Value) -> Column:
    return F.exists(items, lambda x: same(Value(x), wanted))


def _strings(items: Column) -> Column:
    return F.transform(items, lambda x: F.to_json(x))


def _plain(value: object) -> bool:
    """Whether a literal is a string that doesn't read as a number, so that only an equal string is the same."""
    return isinstance(value, str) and not re.search(r"[0-9]", value) and value.strip().lstrip("+-").lower() not in ("inf", "infinity", "nan")


def _texts(items: Column, e: Value) -> tuple[Column, Column] | None:
    """The items and what is expected among them as JSON, each made once, so that sets of texts compare; None where the latter
    aren't plain strings known beforehand."""
    if not isinstance(e.literal, list) or not e.literal or not all(map(_plain, e.literal)):
        return None
    wanted = [F.to_json(F.parse_json(F.lit(json.dumps(x)))) for x in dict.fromkeys(e.literal)]
    return F.transform(items, lambda x: F.coalesce(F.to_json(x), F.lit("null"))), F.array(*wanted)


def _all_members(a: Value, e: Value) -> Column:
    if (texts := _texts(a.items, e)) is not None:
        return F.size(F.array_intersect(*texts)) == len(set(e.literal))
    return F.forall(e.items, lambda x: _member(a.items, Value(x)))


def _any_member(a: Value, e: Value) -> Column:
    if (texts := _texts(a.items, e)) is not None:
        return F.arrays_overlap(*texts)
    return F.exists(e.items, lambda x: _member(a.items, Value(x)))


# Patterns that results must agree on.
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
URL = r"^https?://[a-zA-Z0-9][a-zA-Z0-9-]*(\.[a-zA-Z0-9][a-zA-Z0-9-]*)*(/.*)?$"
ISO8601 = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?)?$"


def _word(a: Value, e: Value) -> Column:
    escaped_ = F.regexp_replace(e.text, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    return F.regexp_like(a.text, F.concat(F.lit(r"\b"), escaped_, F.lit(r"\b")))


def _within(a: Value, e: Value) -> Column:
    return (a.number >= Value(F.get(e.items, F.lit(0))).number) & (a.number <= Value(F.get(e.items, F.lit(1))).number)


def _cased(case: str) -> Callable:
    """All letters are of the case; letters without one (as in Chinese) aren't. Null for a text without letters."""

    def check(a: Value, e: Value) -> Column:
        letters = F.regexp_replace(a.text, r"\P{IsAlphabetic}", "")
        return F.when(letters != "", ~letters.rlike(rf"\P{{{case}}}"))

    return check


def _any_of(a: Value, e: Value) -> Column:
    keyword = F.exists(e.items, lambda x: F.contains(a.text, _get(x, "$", "string")))
    return F.when(a.is_string, keyword).otherwise(_any_member(a, e))


OPERATORS: dict[str, Callable[[Value, Value], Column]] = {
    "equals": same,
    "not_equal": lambda a, e: ~same(a, e),
    "greater_than": lambda a, e: a.number > e.number,
    "greater_than_or_equal": lambda a, e: a.number >= e.number,
    "less_than": lambda a, e: a.number < e.number,
    "less_than_or_equal": lambda a, e: a.number <= e.number,
    "has_length_equal": lambda a, e: a.length == e.number,
    "has_length_greater_than": lambda a, e: a.length > e.number,
    "has_length_less_than": lambda a, e: a.length < e.number,
    "has_length_greater_than_or_equal": lambda a, e: a.length >= e.number,
    "has_length_less_than_or_equal": lambda a, e: a.length <= e.number,
    "contains": lambda a, e: F.when(a.is_string, F.contains(a.text, e.text)).when(a.is_array, _member(a.items, e)),
    "not_contains": lambda a, e: ~F.when(a.is_string, F.contains(a.text, e.text)).when(a.is_array, _member(a.items, e)),
    "starts_with": lambda a, e: F.startswith(a.text, e.text),
    "ends_with": lambda a, e: F.endswith(a.text, e.text),
    "contains_word": _word,
    "matches_regex": lambda a, e: F.regexp_like(a.text, e.text),
    "is_numeric": lambda a, e: a.is_number,
    "is_string": lambda a, e: a.is_string,
    "is_boolean": lambda a, e: a.is_boolean,
    "is_null": lambda a, e: a.is_null,
    "is_array": lambda a, e: a.is_array,
    "is_object": lambda a, e: a.is_object,
    "is_email": lambda a, e: a.text.rlike(anchored(EMAIL)),
    "is_url": lambda a, e: a.text.rlike(anchored(URL)),
    "is_uuid": lambda a, e: a.text.rlike(anchored(UUID)),
    "is_iso8601": lambda a, e: a.text.rlike(anchored(ISO8601)),
    "is_json": lambda a, e: F.try_parse_json(a.text).isNotNull(),
    "in_range": _within,
    "not_in_range": lambda a, e: ~_within(a, e),
    "is_positive": lambda a, e: a.number > 0,
    "is_negative": lambda a, e: a.number < 0,
    "is_zero": lambda a, e: a.number == 0,
    "sequence_matches": lambda a, e: (F.size(a.items) == F.size(e.items)) & F.forall(
        F.zip_with(a.items, e.items, lambda x, y: same(Value(x), Value(y))),
        lambda t: t,
    ),
    "contains_all": _all_members,
    "contains_any": _any_of,
    "contains_none": lambda a, e: ~_any_member(a, e),
    "has_unique_items": lambda a, e: F.size(F.array_distinct(_strings(a.items))) == F.size(a.items),
    "is_empty": lambda a, e: a.is_null | (a.length == 0),
    "is_not_empty": lambda a, e: ~a.is_null & (a.length > 0),
    "is_alphabetic": lambda a, e: a.text.rlike(r"^\p{IsAlphabetic}*\z"),
    "is_alphanumeric": lambda a, e: a.text.rlike(r"^[\p{IsAlphabetic}\p{N}]*\z"),
    "is_lowercase": _cased("IsLowercase"),
    "is_uppercase": _cased("IsUppercase"),
    "approximately_equals": lambda a, e: F.abs(a.number - Value(F.get(e.items, F.lit(0))).number) <= Value(F.get(e.items, F.lit(1))).number,
}
#: Operators that take an array as a whole; any other one, given an array, must hold for each of its items.
WHOLE_ARRAY = {
    "equals",
    "not_equal",
    "has_length_equal",
    "has_length_greater_than",
    "has_length_less_than",
    "has_length_greater_than_or_equal",
    "has_length_less_than_or_equal",
    "contains",
    "not_contains",
    "is_numeric",
    "is_string",
    "is_boolean",
    "is_null",
    "is_array",
    "is_object",
    "sequence_matches",
    "contains_all",
    "contains_any",
    "contains_none",
    "has_unique_items",
    "is_empty",
    "is_not_empty",
}
#: Operators that raise rather than fail on a value they can't judge.
RAISING = {
    "is_lowercase",
    "is_uppercase",
    "is_alphabetic",
    "is_alphanumeric",
    "approximately_equals",
    "matches_regex",
    "contains_word",
    "starts_with",
    "ends_with",
}
_TEMPLATE = re.compile(r"^\$\{(.+)\}$")


def _expected(context: Column, value: object) -> Column:
    """A literal as a variant, or the record's own value at a `${path}`."""
    if isinstance(value, str) and (found := _TEMPLATE.match(value)):
        return F.try_variant_get(context, json_path(found[1]), "variant")
    return F.parse_json(F.lit(json.dumps(value)))


def assertion(context: Column, task: Task) -> Column:
    """struct<passed, actual, expected, error> of one task."""
    if task.operator not in OPERATORS:
        raise ValueError(f"unknown operator {task.operator!r}")
    check = OPERATORS[task.operator]
    actual = F.try_variant_get(context, json_path(task.path), "variant") if task.path else context
    a, e = Value(actual), Value(_expected(context, task.expected), task.expected)
    one = check(a, e)
    if task.operator not in WHOLE_ARRAY or task.item_path:
        item = lambda x: F.try_variant_get(x, json_path(task.item_path), "variant") if task.item_path else x
        one = F.when(a.is_array, F.forall(a.items, lambda x: F.coalesce(check(Value(item(x)), e), F.lit(False)))).otherwise(one)
    error = F.when(
        one.isNull() & ~a.is_null,
        F.concat(F.lit(f"{task.operator} can't judge "), a.kind),
    ) if task.operator in RAISING else F.lit(None).cast("string")
    return F.struct(F.coalesce(one, F.lit(False)).alias("passed"), a.json.alias("actual"), e.json.alias("expected"), error.alias("error"))


def stages(tasks: list[Task]) -> list[list[Task]]:
    """Tasks by depth of dependency; duplicate ids, unknown ids and cycles are errors."""
    ids = [t.id for t in tasks]
    if len(set(ids)) != len(ids):
        raise ValueError("task ids repeat")
    if unknown := {d for t in tasks for d in t.depends_on} - set(ids):
        raise ValueError(f"unknown dependencies: {sorted(unknown)}")
    done: set[str] = set()
    out, left = [], list(tasks)
    while left:
        ready = [t for t in left if set(t.depends_on) <= done]
        if not ready:
            raise ValueError("dependencies form a cycle")
        out.append(ready)
        done |= {t.id for t in ready}
        left = [t for t in left if t.id not in done]
    return out


def evaluate(
    records: DataFrame,
    tasks: list[Task],
    key: str = "record_id",
    context: str = "context",
    judge_scores: DataFrame | None = None,
) -> DataFrame:
    """key, task_id, kind, stage, condition, skipped, passed, actual, expected, error: one row a record and task.

    context holds a variant. A dependency's actual value can be used under its id: a task without a path of its own
    whose path begins with a dependency's id reads there. Judge tasks (kind judge) take their actual value from
    judge_scores (key, task_id, score).
    """
    held = records.select(key, F.col(context).alias("__context"))
    if judge_scores is not None:
        scores = judge_scores.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("task_id", "score"))).alias("__scores"))
        held = held.join(scores, key, "left")
    columns: dict[str, str] = {}
    by_id = {t.id: t for t in tasks}
    for number, stage in enumerate(stages(tasks)):
        made = {}
        for task in stage:
            context_, own = F.col("__context"), task
            if task.kind == "judge":
                context_, own = F.to_variant_object(
                    F.struct(F.col("__scores")[task.id].alias("score"))
                ), Task(task.id, task.operator, task.expected, "score")
            elif task.path and (source := task.path.split(".")[0].split("[")[0]) in task.depends_on:
                context_ = F.parse_json(
                    F.concat(F.lit(json.dumps({source: 0})[:-2]), F.col(columns[source])["result"]["actual"], F.lit("}"))
                )
            gates = [
                ~F.col(columns[d])["skipped"] & (
                    F.col(columns[d])["result"]["passed"] | F.lit(not by_id[d].condition)
                ) for d in task.depends_on
            ]
            skipped = ~reduce(Column.__and__, gates) if gates else F.lit(False)
            columns[task.id] = f"__t{len(columns)}"
            made[columns[task.id]] = F.struct(
                F.lit(task.id).alias("task_id"), F.lit(task.kind).alias("kind"), F.lit(number).alias("stage"), F.lit(task.condition).alias("condition"), skipped.alias("skipped"), assertion(context_, own).alias("result")
            )
        held = held.withColumns(made)
    rows = held.select(key, F.explode(F.array(*columns.values())).alias("x"))
    result = F.col("x.result")
    gone = F.col("x.skipped")
    return rows.select(
        key,
        "x.task_id",
        "x.kind",
        "x.stage",
        "x.condition",
        gone.alias("skipped"),
        (result["passed"] & ~gone).alias("passed"),
        *(F.when(~gone, result[c]).alias(c) for c in ("actual", "expected", "error")),
    )


def workflow_results(rows: DataFrame, key: str = "record_id") -> DataFrame:
    """key, total_tasks, passed_tasks, failed_tasks, pass_rate: without conditional and skipped tasks; 0 where none is left."""
    counts = ~F.col("condition") & ~F.col("skipped")
    held = rows.groupBy(key).agg(F.count_if(counts).alias("total_tasks"), F.count_if(counts & F.col("passed")).alias("passed_tasks"))
    rate = F.when(F.col("total_tasks") > 0, F.col("passed_tasks") / F.col("total_tasks")).otherwise(0.0)
    return held.select(
        key,
        "total_tasks",
        "passed_tasks",
        (F.col("total_tasks") - F.col("passed_tasks")).alias("failed_tasks"),
        rate.alias("pass_rate"),
    )


def result_rows(rows: DataFrame, key: str = "record_id") -> DataFrame:
    return rows.join(workflow_results(rows, key), key)


def result_matrix(
    rows: DataFrame,
    tasks: list[str],
    key: str = "record_id",
    embeddings: DataFrame | None = None,
    targets: list[str] = (),
    metric: str = "similarity",
) -> DataFrame:
    """key and a column a task: 1 passed, 0 failed, skipped or missing.

    embeddings: key and an array column a target, which add the targets' means and pairwise scores (null where a record has
    none), so that histograms can take those as well.
    """
    made = rows.groupBy(key).pivot("task_id", tasks).agg(F.max(F.col("passed").cast("int"))).fillna(0, tasks)
    if embeddings is None:
        return made
    return made.join(embedding_scores(embeddings.select(key, *targets), list(targets), metric).drop(*targets), key, "left")


def embedding_scores(df: DataFrame, targets: list[str], metric: str = "similarity") -> DataFrame:
    """df with `<target>_mean` of each embedding and `<a>_<b>_cosine` of each ordered pair; null where lengths differ."""
    if metric not in ("similarity", "distance"):
        raise ValueError("metric must be similarity or distance")
    made = {}
    for t in targets:
        made[f"{t}_mean"] = F.aggregate(t, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(t)
    for a in targets:
        for b in targets:
            if a != b:
                c = cosine(F.col(a), F.col(b))
                made[f"{a}_{b}_cosine"] = c if metric == "similarity" else 1 - c
    return df.withColumns(made)


# Traces.

MAX_REGEX = 512


def span_filter(expr: dict) -> Column:
    """A predicate over spans: {"name"|"name_regex"|"has_attribute"|"attribute"|"status"|"duration"|"and"|"or": value}."""
    (kind, value), *more = expr.items()
    if more:
        raise ValueError("a filter has one key")
    duration = (F.unix_micros("end_time") - F.unix_micros("start_time")) / 1000
    if kind == "name":
        return F.col("span_name") == value
    if kind == "name_regex":
        if len(value) > MAX_REGEX:
            raise ValueError(f"a regex has at most {MAX_REGEX} characters")
        return F.col("span_name").rlike(value)
    if kind == "has_attribute":
        return F.col("attributes")[value].isNotNull()
    if kind == "attribute":
        return F.coalesce(F.col("attributes")[value[0]] == str(value[1]), F.lit(False))
    if kind == "status":
        return F.col("status_code") == value
    if kind == "duration":
        low, high = value
        return (F.lit(True) if low is None else duration >= low) & (F.lit(True) if high is None else duration <= high)
    if kind in ("and", "or"):
        return reduce(Column.__and__ if kind == "and" else Column.__or__, map(span_filter, value))
    raise ValueError(f"unknown filter {kind!r}")


def _ordered(value: Column, keep: Column | None = None, order: str = "span_order") -> Column:
    item = F.struct(F.col(order).alias("o"), value.alias("v"))
    rows = F.array_sort(F.collect_list(item if keep is None else F.when(keep, item)))
    return F.transform(rows, lambda r: r["v"])


def count_sequence(names: Column, target: list[str]) -> Column:
    """How often the target stands in the ordered names, at any position, without a gap."""
    k = len(target)
    starts = F.when(F.size(names) >= k, F.sequence(F.lit(1), F.size(names) - k + 1)).otherwise(F.array().cast("array<int>"))
    wanted = F.array(*map(F.lit, target))
    return F.size(F.filter(starts, lambda i: F.slice(names, i, k) == wanted))


def _scalar_or_list(items: Column) -> Column:
    return F.when(F.size(items) == 1, F.to_json(F.array(F.element_at(items, 1)))).otherwise(F.to_json(items))


def trace_values(spans: DataFrame, asked: dict[str, tuple]) -> DataFrame:
    """trace_id and a column a question, from one aggregation over spans (with span_order and depth).

    Questions: ("span_sequence", names), ("span_set", names), ("span_count", filter), ("sequence_count", names),
    ("span_exists", filter), ("span_attribute", filter, key), ("span_duration", filter),
    ("span_aggregation", filter, key, function), ("trace_duration",), ("trace_span_count",), ("trace_error_count",),
    ("trace_service_count",), ("trace_max_depth",), ("trace_attribute", key), ("attribute_filter", key, task, mode).
    """
    numbers = {"sum": F.sum, "average": F.avg, "min": F.min, "max": F.max, "count": F.count}
    aggs = []
    for name, (kind, *args) in asked.items():
        if kind == "span_sequence":
            value = _ordered(F.col("span_name")) == F.array(*map(F.lit, args[0]))
        elif kind == "span_set":
            value = F.size(F.array_except(F.array(*map(F.lit, args[0])), F.collect_set("span_name"))) == 0
        elif kind == "span_count":
            value = F.count_if(span_filter(args[0]))
        elif kind == "sequence_count":
            value = count_sequence(_ordered(F.col("span_name")), args[0])
        elif kind == "span_exists":
            value = F.bool_or(span_filter(args[0]))
        elif kind == "span_attribute":
            value = _scalar_or_list(_ordered(F.col("attributes")[args[1]], span_filter(args[0]) & F.col("attributes")[args[1]].isNotNull()))
        elif kind == "span_duration":
            value = _scalar_or_list(
                _ordered(F.floor((F.unix_micros("end_time") - F.unix_micros("start_time")) / 1000), span_filter(args[0]))
            )
        elif kind == "span_aggregation":
            x = F.when(span_filter(args[0]), F.col("attributes")[args[1]].try_cast("double"))
            value = numbers[args[2]](x) if args[2] in numbers else (F.min_by if args[2] == "first" else F.max_by)(
                x,
                F.when(x.isNotNull(), F.col("span_order")),
            )
        elif kind == "trace_duration":
            value = F.floor((F.max(F.unix_micros("end_time")) - F.min(F.unix_micros("start_time"))) / 1000)
        elif kind == "trace_span_count":
            value = F.count("*")
        elif kind == "trace_error_count":
            value = F.count_if(F.col("status_code") == 2)
        elif kind == "trace_service_count":
            value = F.size(F.collect_set("service_name")).cast("long")  # a distinct count would shuffle all spans twice more
        elif kind == "trace_max_depth":
            value = F.max("depth")
        elif kind == "trace_attribute":
            value = F.max(F.when(F.col("parent_span_id").isNull(), F.col("attributes")[args[0]]))
        elif kind == "attribute_filter":
            text = F.col("attributes")[args[0]]
            held = assertion(F.coalesce(F.try_parse_json(text), F.to_variant_object(F.struct(text.alias("raw")))), args[1])["passed"]
            value = (F.bool_or if args[2] == "any" else F.bool_and)(F.when(text.isNotNull(), held))
        else:
            raise ValueError(f"unknown question {kind!r}")
        aggs.append(value.alias(name))
    return spans.groupBy("trace_id").agg(*aggs)


# Tool calls and responses: tool_calls array<struct<name, arguments variant, result variant>>; responses: content, model, finish_reason,
# input_tokens, output_tokens, raw variant.


def partial_match(actual: Column, wanted: dict) -> Column:
    """Every wanted key is among the arguments with an equal value, nested objects likewise."""
    tests = []
    for k, v in wanted.items():
        own = F.try_variant_get(actual, json_path(k), "variant")
        tests.append(partial_match(own, v) if isinstance(v, dict) else same(Value(own), Value(F.parse_json(F.lit(json.dumps(v))))))
    return reduce(Column.__and__, tests) if tests else F.lit(True)


def tool_called(name: str, arguments: dict | None = None) -> Column:
    return F.exists(
        "tool_calls",
        lambda c: F.coalesce((c["name"] == name) & (partial_match(c["arguments"], arguments) if arguments else F.lit(True)), F.lit(False)),
    )


def tool_not_called(name: str) -> Column:
    return ~tool_called(name)


def tool_call_count(name: str | None = None) -> Column:
    return F.size(F.filter("tool_calls", lambda c: (c["name"] == name) if name else F.lit(True)))


def tool_call_sequence(names: list[str]) -> Column:
    """The names are called in this order, others may be called between."""
    wanted = F.array(*map(F.lit, names))
    found = F.aggregate("tool_calls", F.lit(0), lambda i, c: F.when((i < len(names)) & (c["name"] == F.get(wanted, i)), i + 1).otherwise(i))
    return found == len(names)


def tool_argument(name: str, path: str) -> Column:
    """The argument of the first call of the tool, as JSON."""
    call = F.element_at(F.filter("tool_calls", lambda c: c["name"] == name), 1)
    return F.when(tool_call_count(name) > 0, F.to_json(F.try_variant_get(call["arguments"], json_path(path), "variant")))


def tool_result(name: str) -> Column:
    call = F.element_at(F.filter("tool_calls", lambda c: c["name"] == name), 1)
    return F.when(tool_call_count(name) > 0, F.to_json(call["result"]))


def response_content() -> Column:
    """The text of the response; null where it is empty."""
    return F.nullif("content", F.lit(""))


def response_model() -> Column:
    return F.col("model")


def response_finish_reason() -> Column:
    return F.col("finish_reason")


def response_input_tokens() -> Column:
    return F.col("input_tokens").cast("long")


def response_output_tokens() -> Column:
    return F.col("output_tokens").cast("long")


def response_total_tokens() -> Column:
    """Input and output tokens; null where either is unknown."""
    return response_input_tokens() + response_output_tokens()


def response_field(path: str) -> Column:
    """What is at the path of the raw response, as JSON; null where there is nothing."""
    return F.to_json(F.try_variant_get("raw", json_path(path), "variant"))
