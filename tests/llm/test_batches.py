"""Packing, mixing, URL rules, reply trees, components and the pipeline."""

import hashlib
import itertools
import math
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skeinwatch.llm import chat, common, components, mixing, packing, url_filter
from skeinwatch.llm.common import maybe_among


def test_bounds_are_optimal():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(1, 9))
        x, w, k = np.sort(rng.choice(40, n, replace=False)) + 1, rng.integers(1, 9, n), int(rng.integers(1, 5))
        cost = lambda b, x=x, w=w: sum(c * (min(q for q in b if q >= v) - v) for v, c in zip(x, w, strict=True))
        best = min(cost({*inner, x[-1]}) for m in range(min(k, n)) for inner in itertools.combinations(x[:-1].tolist(), m))
        got = packing.optimal_bounds(x, w, k)
        assert cost(got) == best and len(got) <= k


def test_pack_places_every_token_once(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(["w"] * int(n)) for n in rng.integers(0, 90, 300)] + [None, "", "x " * 1000]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, bucket_len int")
    got = packing.pack(docs, max_len=64, buckets=4, token_budget=256, part_rows=20).collect()
    total = defaultdict(int)
    for r in got:
        total[r["doc_id"]] += r["n_tokens"]
        assert 0 < r["n_tokens"] <= r["bucket_len"] <= 64
    assert total == {i: len((t or "").split()) + 1 for i, t in enumerate(texts)}
    assert len({r["bucket_len"] for r in got}) <= 4
    batches = defaultdict(list)
    for r in got:
        batches[r["bucket_len"], r["batch"]].append(r["slot"])
    for (size, batch), slots in batches.items():
        assert sorted(slots) == list(range(len(slots))) and len(slots) * size <= 256
        last = max(b for s, b in batches if s == size)
        assert batch == last or len(slots) == 256 // size
    assert packing.pack(docs.where("false")).count() == 0


def reference_exponent(tokens, limit):
    lo, hi = 0.0, 1.0
    ratio = max(tokens) / min(tokens)
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if ratio ** (1 - mid) <= limit else (mid, hi)
    return hi


def test_mixing_keeps_all_and_meets_the_limit(spark):
    rng = np.random.default_rng(4)
    rows = [
        (i, "big" if i % 3 else f"s{i % 4}" if i % 12 else None, " ".join(["w"] * int(n)), "x") for i,
        n in enumerate(rng.integers(0, 50, 2000))
    ]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, epoch string")
    tokens = Counter()
    for _, s, t, _ in rows:
        tokens[s] += len(t.split()) + 1
    got = mixing.mixed(docs, repetition=2.0, block_tokens=50).collect()
    copies = Counter(r["doc_id"] for r in got)
    assert set(copies) == set(range(2000)) and max(copies.values()) <= 2
    drawn = Counter()
    for r in got:
        drawn[r["source"]] += r["n_tokens"]
    exponent = reference_exponent(list(tokens.values()), 2.0)
    weights = {s: t**exponent for s, t in tokens.items()}
    z = sum(weights.values())
    budget = max(tokens[s] / (weights[s] / z) for s in tokens)
    for s in tokens:
        target = budget * weights[s] / z
        assert drawn[s] <= target + 1 and drawn[s] > target - 200
    assert all(0 <= r["position"] <= 1.0 + 1e-9 for r in got)
    assert got and len({(r["doc_id"], r["epoch"]) for r in got}) == len(got)


def test_mixing_to_an_entropy_and_empty(spark):
    totals = spark.createDataFrame([("a", 800, 1), ("b", 100, 1), ("c", 100, 1)], "source string, tokens long, docs long")
    exponent = mixing.solve_exponent(totals, entropy=1.3)
    w = np.array([800, 100, 100.0]) ** exponent
    p = w / w.sum()
    assert math.isclose(-(p * np.log2(p)).sum(), 1.3, abs_tol=1e-6)
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mixed(empty).count() == 0
    with pytest.raises(ValueError):
        mixing.solve_exponent(totals)


def page(url, canonical=None, refresh=None):
    head = f'<link rel="canonical" href="{canonical}">' if canonical else ""
    head += f'<meta http-equiv="refresh" content="0; url={refresh}">' if refresh else ""
    return url, f"<html>{head}</html>"


def test_url_rules_and_aliases(spark):
    urls = [
        page("http://A.example.org/es/1"),
        page("http://example.org/en/123?x"),
        page("http://x.com/fr/a"),
        page("https://y.com/de/b#t"),
        page("ftp://z.net/a", canonical="https://y.com/de/b"),
        page("http://z.net/a/"),
        page("http://q.net/p", refresh="/home"),
        page("http://q.net/home", canonical="http://z.net/a"),
        (None, None),
        page("no scheme"),
        page("http://org"),
        page("http://notorg/x"),
        page("http://k.net/1", canonical="http://y.com/de/c"),
        page("http://k.net/2", canonical="http://k.net/1"),
        page("http://o.org/", canonical="http://k.net/1"),
    ]
    df = spark.createDataFrame([(i, *u, "v") for i, u in enumerate(urls)], "page_id long, url string, html string, verdict string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(df).collect()}
    assert [got[i]["verdict"] for i in range(4)] == ["block", "block", "allow", "block"]
    assert got[0]["rule"] == "example.org/es/" and got[0]["host"] == "a.example.org" and got[1]["path"] == "/en/123"
    assert [got[i]["verdict"] for i in (4, 5, 6, 7)] == ["block"] * 4 and got[7]["reason"] == "alias"
    assert got[8]["host"] == got[8]["path"] == got[9]["host"] == "" and got[8]["verdict"] == "allow"
    assert got[10]["rule"] is None and got[11]["rule"] is None
    assert [got[i]["verdict"] for i in (12, 13, 14)] == ["allow"] * 3  # the class holds an allowed URL


def test_aliases_are_judged_by_their_own_urls(spark):
    urls = [
        page("http://y.com/de", canonical="http://z.net/a"),
        page("http://z.net/a"),
        page("http://k.net/1", refresh="http://w.com/de"),
        page("http://k.net/2", canonical="http://w.com/de/"),
        page("http://m.net/x"),
        page("http://m.net/x"),
        page("http://long.net/" + "p" * 100_000, canonical="http://y.com/de/q"), page("http://both.net/a", canonical="http://both.net/a"),
    ]
    df = spark.createDataFrame([(i, *u) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(df).collect()}
    assert (got[0]["rule"], got[0]["path"], got[0]["verdict"]) == (None, "/de", "allow") and got[1]["verdict"] == "allow"
    assert got[2]["verdict"] == "block"  # w.com/de and w.com/de/ are one node, and the latter is blocked by a rule
    assert got[3]["verdict"] == got[6]["verdict"] == "block" and got[7]["verdict"] == "allow"
    assert url_filter.judge_urls(df.unionByName(df)).count() == 2 * len(urls)
    rules = (
        url_filter.UrlRule("block", "a.b.net", "/x"),
        url_filter.UrlRule("allow", "b.net", "/x/yz"),
        url_filter.UrlRule("allow", "a.b.net", "/z"),
        url_filter.UrlRule("block", "a.b.net", "/z"),
    )
    some = spark.createDataFrame(
        [(0, "http://a.b.net/x/yzq", None), (1, "http://a.b.net/zz", None)],
        "page_id long, url string, html string",
    )
    assert [r["verdict"] for r in url_filter.judge_urls(some, rules).orderBy("page_id").collect()] == ["allow", "allow"]
    moved = spark.createDataFrame([("http://c.net/1", "http://d.com/de/1")], "src string, dst string")
    one = spark.createDataFrame([(0, "http://c.net/1", None)], "page_id long, url string, html string")
    assert url_filter.judge_urls(one, redirects=moved).first()["verdict"] == "block"
    assert url_filter.judge_urls(one.where("false")).count() == 0
    assert url_filter.judge_urls(df.where("false")).count() == 0


def test_equal_forms_are_aliases_with_and_without_links(spark):
    for head in ({}, {"canonical": "http://b.com/x"}):
        urls = [page("http://a.com/de/", **head), page("http://a.com/de"), page("https://www.a.com/de?utm_source=y#t"), page("http://a.com/de?z=1")]
        df = spark.createDataFrame([(i, *u) for i, u in enumerate(urls)], "page_id long, url string, html string")
        got = {r["page_id"]: (r["verdict"], r["reason"]) for r in url_filter.judge_urls(df).collect()}
        assert got == {0: ("block", "rule"), 1: ("block", "alias"), 2: ("block", "alias"), 3: ("allow", "default")}


def test_components_match_union_find(spark):
    rng = np.random.default_rng(6)
    pairs = [
        (int(a), int(b)) for a,
        b in rng.integers(0, 400, (300, 2))
    ] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, x) for x in range(6000, 6200)] + [(3, 3)]
    label = {}

    def root(x):
        label.setdefault(x, x)
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = sorted((root(a), root(b)))
            label[y] = x
    got = {
        r["node"]: r["component"] for r in components.connected_components(
            spark.createDataFrame([*pairs, (None, 1)], "src long, dst long")
        ).collect()
    }
    assert got == {x: root(x) for x in label}


def test_chat_reads_back_every_conversation(spark, sf):
    odd = [
        (-7, 0, "user", "</s>[INST] ok [/INST]"),
        (-8, 0, "a\n\\n\\", "<\\|im_end|>\n<|im_end|>\n<<SYS>> $1 \\ [\\\\/INST]"),
        (-8, 1, None, None),
        (-8, 1, "assistant", ""),
        (-9, 5, "assistant", "x" * 200_000),
    ]
    said = spark.read.parquet(f"{sf}/conversations.parquet").unionByName(
        spark.createDataFrame(odd, "conv_id long, turn long, role string, text string")
    ).withColumn("formatted", F.lit(1))
    turns = defaultdict(list)
    for r in said.collect():
        turns[r["conv_id"]].append((r["turn"], r["role"] or "", r["text"] or ""))
    got = chat.chat_digest(said).collect()
    assert len(got) == len(turns)
    for r in got:
        own = sorted(turns[r["conv_id"]])
        loss = "".join(t for _, role, t in own if role == "assistant")
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.chat_digest(said.where("false")).count() == 0


def test_reply_trees_choose_the_best_branch(spark):
    rows = [
        (1, None, 0.0, "user", "hi"),
        (2, 1, 1.0, "assistant", "a"),
        (3, 1, 2.0, "assistant", "b"),
        (4, 3, None, "user", "more"),
        (5, 4, 0.5, "assistant", "</s>end"),
        (6, 2, 5.0, "user", "x"),
        (9, None, 1.0, "user", "alone"),
    ]
    df = spark.createDataFrame(rows, "id long, parent long, score double, role string, text string")
    one = {r["tree"]: r for r in chat.chat_paths(df).collect()}
    assert one[1]["leaf"] == 6 and one[1]["path_score"] == 6.0 and one[9]["leaf"] == 9
    both = {r["leaf"]: r for r in chat.chat_paths(df, per_tree=2).collect()}
    assert both[5]["branch"] == 2 and "</s>" not in both[5]["formatted"] and [
        x["end"] - x["start"] for x in both[5]["loss_spans"]
    ] == [1, 8]


def test_reply_cycles_are_on_no_path_and_what_hangs_on_one_is_an_error(spark):
    kind = "id long, parent long, score double, role string, text string"
    cycle = [(1, 3, 0.0, "user", "a"), (2, 1, 0.0, "user", "b"), (3, 2, 0.0, "user", "c")]
    alone = [(7, None, 0.0, "user", "d"), (8, 7, 0.0, "assistant", "e")]
    assert [r["leaf"] for r in chat.chat_paths(spark.createDataFrame(cycle + alone, kind)).collect()] == [8]
    with pytest.raises(RuntimeError, match="cycle"):
        chat.chat_paths(spark.createDataFrame([*cycle, (4, 1, 0.0, "user", "f")], kind))


def test_long_chain_of_replies_leaves_one_table(spark):
    folder = Path(common.shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    rows = spark.range(1, 301).select("id", F.expr("nullif(id - 1, 0)").alias("parent"), F.lit(1.0).alias("score"))
    got = chat.paths(rows).collect()
    assert sorted((r["depth"], r["id"]) for r in got) == [(i, i + 1) for i in range(300)]
    assert {r["path_score"] for r in got} == {300.0} and len(set(folder.iterdir()) - before) == 1


def test_pipeline_stages(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language ID",
        "SimHash near-dedup",
        "secret scans",
        "mixing sources to target weights",
        "packing",
    ]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame(
        [(900001, "12345 !!", "en", "src0", 8), (900002, None, None, None, None), (900003, docs.first()["text"], "fr", "src1", 1)],
        docs.schema,
    )
    held = docs.unionByName(odd)
    ids = lambda df: Counter(r["doc_id"] for r in df.select("doc_id").collect())
    seen = [ids(held)]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        held = stage(spark, held, sf).cache()
        assert held.columns == docs.columns
        seen.append(ids(held))
    assert 900001 not in seen[1] and 900002 not in seen[1] and 900003 in seen[1]
    assert 900003 not in seen[2]
    assert seen[3] == seen[2] and set(seen[4]) == set(seen[3]) and max(seen[4].values()) <= 2
    packed = corpus_pipeline.STAGES[-1][1](spark, held, sf)
    assert set(ids(packed)) == set(seen[4])
    assert corpus_pipeline.run(spark, sf).count() > 0


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_stages_on_no_documents(spark, sf, stage):
    empty = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    assert corpus_pipeline.STAGES[stage][1](spark, empty, sf).count() == 0


def test_key_bitmap_misses_no_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4990, F.col("id")).alias("doc_id"), F.lit("x").alias("text"))
    keys = df.where("doc_id % 7 = 0").select("doc_id")
    marked = maybe_among(df, keys, "doc_id")
    assert marked.count() == 5000 and marked.columns == ["doc_id", "text", "__maybe"]
    assert marked.where("doc_id % 7 = 0 and not __maybe").count() == 0
    assert marked.where("__maybe").count() < keys.count() + 20
    assert maybe_among(df, keys.where("false"), "doc_id").where("__maybe").count() == 0
