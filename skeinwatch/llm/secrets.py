"""Secret scans through a trigram inverted index, in DataFrame functions only.

Each rule's regular expression yields a Boolean trigram query: an AND of clauses, each an OR of trigram sets, that every
text with a match satisfies. The index holds postings (trigram, doc_id) of the trigrams that rules ask for, taken from
the lower-cased whole texts; postings are intersected by document and the candidates verified with the expressions.
A rule without a mandatory trigram (a run of hexadecimal digits) has no query and scans every text.

Matches are the leftmost, non-overlapping ones of each rule; offsets are code points, ends exclusive. Null texts count
as empty. Repeated rows each give a row; rows that share a doc_id share candidates, which verification makes harmless.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as op
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwatch.llm.common import cuts, folded, maybe_among, written


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a match counts if group `group` has at least `least` characters."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),  # the same matches as AKIA[A-Z0-9]+ of 16 or more characters
    Rule("hex", r"[0-9a-f]{32,}"),  # likewise: runs are maximal
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
)
RULES = BASE + MORE
_STRINGS, _CLASS = 64, 5  # most strings a set of alternatives keeps; most characters of a class that is spelled out


def _joined(clauses: list, strings: set[str]) -> list:
    """clauses and what the alternatives in strings need; nothing if one of them is shorter than a trigram."""
    sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    if not sets or frozenset() in sets:
        return clauses
    return [*clauses, {s for s in sets if not any(o < s for o in sets)}]


def _walk(items) -> tuple[list, set[str] | None]:
    """Clauses that a match satisfies, and the strings that can match if these are few (else None)."""
    clauses: list = []
    run: set[str] | None = {""}
    exact = True
    for kind, value in items:
        strings: set[str] | None = None
        inner: list = []
        if kind is op.LITERAL:
            strings = {chr(value).lower()}
        elif kind is op.IN and value[0][0] is not op.NEGATE:
            chars = {
                chr(c).lower() for k,
                v in value if k in (op.LITERAL, op.RANGE) for c in ([v] if k is op.LITERAL else range(v[0], min(v[1], v[0] + 99) + 1))
            }
            strings = chars if len(chars) <= _CLASS and all(k in (op.LITERAL, op.RANGE) for k, _ in value) else None
        elif kind is op.SUBPATTERN:
            inner, strings = _walk(value[-1])
        elif kind is op.BRANCH:
            parts = [_walk(x) for x in value[1]]
            if all(s is not None for _, s in parts):
                strings = set().union(*(s for _, s in parts))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            low, high, part = value
            sub, own = _walk(part)
            if own is not None and high == 1:
                strings = own | ({""} if low == 0 else set())
            elif own is not None and low == high and high * max(map(len, own), default=0) <= 16 and len(own) ** int(high) <= _STRINGS:
                strings = {"".join(x) for x in product(own, repeat=int(high))}
            elif low > 0:
                inner = sub if own is None else _joined(list(sub), own)
        elif kind is op.AT:
            strings = {""}
        clauses += inner
        if strings is not None and len(run) * len(strings) <= _STRINGS:
            run = {a + b for a in run for b in strings}
        else:
            exact = False
            clauses = _joined(clauses, run)
            run = strings if strings is not None and len(strings) <= _STRINGS else {""}
    return (clauses, run) if exact else (_joined(clauses, run), None)


def trigram_query(regex: str) -> list[set[frozenset[str]]]:
    """AND over clauses, OR within a clause, AND within a set; an empty list if no trigram is mandatory."""
    clauses, run = _walk(list(parser.parse(regex)))
    return _joined(clauses, run) if run is not None else clauses


def trigrams_of(rules: tuple[Rule, ...]) -> list[str]:
    return sorted({t for rule in rules for clause in trigram_query(rule.regex) for s in clause for t in s})


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index: trigram and doc_id, for the trigrams asked for, over lower-cased whole texts."""
    lowered = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("__low"))
    found = F.array_compact(
        F.array(*(F.when(F.col("__low").contains(t), F.lit(t)) for t in trigrams))
    ) if trigrams else F.array().cast("array<string>")
    return lowered.select("doc_id", F.explode(found).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """doc_id and the indexed rules (positions in rules) whose trigram queries its postings satisfy."""
    known = {t: i for i, t in enumerate(trigrams_of(rules))}
    words = range(max(1, -(-len(known) // 62)))
    place = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    held = index.select("doc_id", place[F.col("trigram")].alias("__i"))
    masks = held.groupBy("doc_id").agg(
        *(
            F.bit_or(
                F.when(F.floor(F.col("__i") / 62) == w, F.expr("shiftleft(1L, __i % 62)")).otherwise(F.lit(0).cast("long"))
            ).alias(f"__w{w}") for w in words
        )
    )

    def has(needs: frozenset[str]) -> Column:
        masks_ = [sum(1 << known[t] % 62 for t in needs if known[t] // 62 == w) for w in words]
        return reduce(Column.__and__, (F.col(f"__w{w}").bitwiseAND(F.lit(m)) == F.lit(m) for w, m in zip(words, masks_, strict=True) if m))

    def satisfied(rule: Rule) -> Column:
        return reduce(Column.__and__, (reduce(Column.__or__, map(has, sorted(clause, key=sorted))) for clause in trigram_query(rule.regex)))

    asked = [F.when(satisfied(r), F.lit(i)) for i, r in enumerate(rules) if trigram_query(r.regex)]
    return masks.select("doc_id", F.array_compact(F.array(*asked)).alias("__rules")).where(F.size("__rules") > 0)


_SPAN = "struct<start:int,kind:int,end:int,name:string>"


def match_spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, kind, end, name>> of one rule's matches; kind is the rule's place in the listing."""
    regex = F.lit(rule.regex)
    empty = F.array().cast(f"array<{_SPAN}>")
    hits = F.regexp_extract_all(text, regex, F.lit(0))
    rows = [F.transform(F.split(text, rule.regex), F.length).alias("gap"), F.transform(hits, F.length).alias("size")]
    if rule.group:
        rows.append(F.transform(F.regexp_extract_all(text, regex, F.lit(rule.group)), F.length).alias("held"))
    rows = F.filter(F.arrays_zip(*rows), lambda x: x["size"].isNotNull())

    def step(at, x):
        start, end = at + x["gap"], at + x["gap"] + x["size"]
        span = F.struct(
            start.cast("int").alias("start"),
            F.lit(order).alias("kind"),
            end.cast("int").alias("end"),
            F.lit(rule.kind).alias("name"),
        )
        return end, F.when(x["held" if rule.group else "size"] >= rule.least, F.array(span)).otherwise(empty)

    return F.when(text.rlike(rule.regex), folded(rows, F.lit(0), step, _SPAN)).otherwise(empty)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with `__spans`: every verified match of every rule, by start, then by the rules' order.

    Only texts whose doc_id may be among the candidates (by a bitmap of bounded size) are shuffled to the join with them.
    """
    found = written(candidates(postings(docs, trigrams_of(rules)), rules).withColumnRenamed("doc_id", "__doc_id"), "candidates")
    marked = maybe_among(docs, found.select(F.col("__doc_id").alias("doc_id")), "doc_id")
    likely = marked.where("__maybe").drop("__maybe")
    joined = likely.join(found, likely["doc_id"].eqNullSafe(found["__doc_id"]), "left").drop("__doc_id")
    rest = marked.where("not __maybe").drop("__maybe").withColumn("__rules", F.lit(None).cast("array<int>"))

    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast(f"array<{_SPAN}>")
    indexed = [i for i, rule in enumerate(rules) if trigram_query(rule.regex)]

    def spans(asked: bool) -> Column:
        out = []
        for i, rule in enumerate(rules):
            if i not in indexed:
                out.append(match_spans(text, rule, i))
            elif asked:
                out.append(F.when(F.coalesce(F.array_contains("__rules", i), F.lit(False)), match_spans(text, rule, i)).otherwise(none))
        return F.array_sort(F.concat(*out)) if out else none

    return joined.withColumn("__spans", spans(True)).unionByName(rest.withColumn("__spans", spans(False))).drop("__rules")


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))))


def secret_digest(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, counts and digest of the base kinds' spans, and all spans as kind:start:end."""
    spans, base = F.col("__spans"), F.filter("__spans", lambda s: s["kind"] < len(BASE))

    def number(i: int) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == i)).cast("long").alias(f"n_{BASE[i].kind}")

    counts = map(number, range(len(BASE)))
    return scan(docs.select("doc_id", "text"), rules).select(
        "doc_id",
        *counts,
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(spans).alias("spans"),
    )


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret in text replaced by mark (overlapping spans by one) and n_chars brought up to date; null texts stay null."""
    kept = docs.columns
    text = F.col("text")
    pair = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def merge(held, s):
        """held: the span so far, which overlapping ones widen; one that begins behind it lets it go."""
        behind = s["start"] >= held["end"]
        next_ = F.when(behind, pair(s["start"], s["end"])).otherwise(pair(held["start"], F.greatest(held["end"], s["end"])))
        return next_, F.when(behind & (held["end"] > 0), F.array(held)).otherwise(none)

    first = pair(F.lit(0), F.lit(0))
    merged = folded(F.col("__spans"), first, merge, "struct<start:int,end:int>", last=lambda held: F.array(held))
    ends = F.concat(F.array(F.lit(0)), F.transform("__merged", lambda s: s["end"]))
    starts = F.concat(F.transform("__merged", lambda s: s["start"]), F.array(F.length(text)))
    gaps = F.arrays_zip(ends.alias("start"), starts.alias("end"))
    done = scan(docs, rules).withColumn("__hit", text.isNotNull() & (F.size("__spans") > 0))
    done = done.withColumn("__merged", F.when(F.col("__hit"), merged))
    done = done.withColumn("text", F.when(F.col("__hit"), F.array_join(cuts(text, gaps), mark)).otherwise(text))
    return (done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in kept else done).select(*kept)
