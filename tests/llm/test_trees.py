"""Merkle manifest, jump shards and prefix trie against plain Python."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from skeinwatch.llm import merkle, prefix_trie, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TALK = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def put(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_tree(leaves):
    """root, and for each leaf its (left, right) siblings, level by level."""
    paths, spots, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, at in enumerate(spots):
            first = at - at % 3
            paths[i].append(("".join(level[first:at]), "".join(level[at + 1 : first + 3])))
        spots = [s // 3 for s in spots]
        level = [sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
    return level[0], paths


def plain_manifest(docs):
    def leaf(d, text):
        return sha("".join(put(x) for x in (d[0], d[3], d[2], d[4], text)))

    groups = defaultdict(list)
    for d in docs:
        groups[d[3]].append((d[0] is not None, d[0] or 0, leaf(d, d[1]), d))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        rows = sorted(groups[s], key=lambda r: r[:3])
        trees[s] = (rows, *plain_tree([r[2] for r in rows]))
    root, over = plain_tree([trees[s][1] for s in order])
    out = []
    for s, above in zip(order, over, strict=True):
        rows, sub, paths = trees[s]
        for (_, _, digest, d), path in zip(rows, paths, strict=True):
            whole = path + above
            cut = d[0] is not None and d[1] is not None and zlib.crc32(str(d[0]).encode()) % 2 == 0
            at = leaf(d, d[1].replace("\n", "")) if cut else digest
            for left, right in whole:
                at = sha(left + at + right)
            out.append((d[0], digest, sub, root, sha("".join(a + b for a, b in whole)), at, at == root))
    return Counter(out)


def documents():
    docs = [(i, f"text {i}\nline" if i % 3 else f"text {i}", "en", "hot", i) for i in range(300)]
    docs += [(i, "a\nb", None, f"s{i}", None) for i in range(1000, 1012)]
    docs += [(2000 + i, None, "de", None, 4) for i in range(4)]
    docs += [(5, "same\n", "en", "ties", 5)] * 7 + [(5, "other", "en", "ties", 5), (None, "no\nid", "en", "ties", 1), (None, "", "en", "é", 0)]
    docs += [(3000 + i, "x\n" * 5000, "en", "Z", 1) for i in range(82)]
    return docs


def test_manifest(spark):
    docs = documents()
    df = spark.createDataFrame(docs, DOCS).withColumn("path", F.lit(1)).withColumn("__group", F.lit("x")).repartition(3)
    got = merkle.manifest_digest(df)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(tuple(r) for r in got.collect()) == plain_manifest(docs)


@pytest.mark.parametrize("n", [0, 1, 81, 82])
def test_manifest_sizes(spark, n):
    docs = [(i, f"{i}\n", "en", "s", i) for i in range(n)]
    assert Counter(tuple(r) for r in merkle.manifest_digest(spark.createDataFrame(docs, DOCS)).collect()) == (plain_manifest(docs) if n else Counter())


def test_many_levels(spark):
    rows = spark.range(20_000).withColumn("g", F.when(F.col("id") % 3 > 0, "a"))
    got = merkle.manifest(rows, "g", "id", F.sha2(F.col("id").cast("string"), 256), {"id": F.col("id")})
    wrong = got.where(merkle.folded(F.col("leaf"), F.col("path")) != F.col("root"))
    assert wrong.count() == 0 and got.count() == 20_000
    leaves = [sha(str(i)) for i in range(20_000) if i % 3]
    assert {r["subroot"] for r in got.where("id % 3 > 0").select("subroot").distinct().collect()} == {plain_tree(leaves)[0]}


def plain_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def plain_key(*values):
    return int(hashlib.md5("".join(map(put, values)).encode()).hexdigest()[:15], 16)


@pytest.mark.parametrize("shards", [1, 16, 1000])
def test_jump(spark, shards):
    keys = [0, 1, 2**63, 2**64 - 1] + [plain_key(i) for i in range(500)]
    df = spark.createDataFrame([(str(k),) for k in keys], "k string")
    got = df.select("k", sharding.jump(F.col("k").cast("decimal(20,0)"), shards).alias("s")).collect()
    assert {int(r["k"]): r["s"] for r in got} == {k: plain_jump(k, shards) for k in keys}


def test_rows_that_need_more_jumps(spark, monkeypatch):
    monkeypatch.setattr(sharding, "JUMPS", 1)
    df = spark.range(200).select("id", sharding.jump(F.col("id").cast("decimal(20,0)"), 50).alias("s"))
    assert all(r["s"] == plain_jump(r["id"], 50) for r in df.collect())


def test_shards(spark):
    docs = documents()
    df = spark.createDataFrame(docs, DOCS).withColumn("shard", F.lit("clash")).withColumn("__at", F.lit(1)).repartition(3)
    got = sharding.shard_digest(df).collect()
    expected = Counter()
    for d in docs:
        text = (d[1] or "").encode()
        shards = [plain_jump(plain_key(d[0]), n) for n in (16, 17)]
        assert shards[1] in (shards[0], 16)
        expected[(d[0], len(text) + 1, zlib.crc32(text), "key", *shards)] += 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in got) == expected
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append((r["slot"], r["doc_id"] or -1))
    for of in slots.values():
        assert [s for s, _ in sorted(of)] == list(range(len(of)))
        assert [d for _, d in sorted(of)] == sorted(d for _, d in of)
    assert sharding.shard_digest(df.where("false")).count() == 0


def test_moves_and_written_shards(spark, tmp_path):
    rows = spark.range(5000).withColumn("k", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")))
    moved = sharding.moves(rows, ["id"], 10, 11).collect()
    assert sum(r["n_rows"] for r in moved) == 5000
    assert all(r["shard_after"] in (r["shard_before"], 10) for r in moved)
    share = sum(r["n_rows"] for r in moved if r["shard_after"] == 10) / 5000
    assert abs(share - 1 / 11) < 0.02
    sharding.write_shards(rows, str(tmp_path / "s"), ["k"], 4, files=3)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(map(tuple, back.select("id", "k").collect())) == sorted(map(tuple, rows.collect()))
    assert back.where("k = 'hot'").select("shard").distinct().count() == 1
    assert 2 <= back.where("k = 'hot'").select(F.input_file_name().alias("f")).distinct().count() <= 3


def plain_trie(rows):
    talk = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            talk[c].append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in talk.items()}
    again = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 4
        again[c] = said.get(c - c % 20, [])[:h] + own[h:]
    nodes = defaultdict(set)
    for c, seq in again.items():
        for d in range(len(seq) + 1):
            nodes[tuple(seq[:d])].add(c)
    kids, leaves, saved = Counter(), Counter(), Counter()
    for node in nodes:
        if node:
            kids[node[:-1]] += 1
    for node, members in nodes.items():
        words = len([w for w in node[-1][1].replace("\t", " ").replace("\n", " ").split(" ") if w]) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(members) - 1) * words
    out = set()
    for node, members in nodes.items():
        ends = sorted(c for c in members if len(again[c]) == len(node))
        parent = min(nodes[node[:-1]]) if node else None
        out.add((min(members), len(node), parent, len(members), kids[node], leaves[node], saved[node], sha(",".join(map(str, ends)))))
    return out


def talks():
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"say {t} {'x' if c % 3 else 'y'}\tword\n") for c in range(1, 90) for t in range(c % 7 + 1)]
    rows += [(c, t, "user", "copy of all") for c in range(1000, 1700) for t in range(3)]  # one third of all conversations
    rows += [(2000, t, "user", f"long {t}") for t in range(70)]
    rows += [(2001, t, "user", f"long {t}") for t in range(60)]
    rows += [(3001, None, None, None), (3001, 1, "user", ""), (3002, None, "", ""), (3002, 1, "user", None), (None, 1, "user", "lost")]
    return rows + [(3019, 0, "user", "one turn"), (3040, 0, "user", "one turn")]


def test_trie(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STRETCH", 16)
    rows = talks()
    df = spark.createDataFrame(rows, TALK).withColumn("d", F.lit(1)).withColumn("node", F.lit("x")).repartition(5)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = prefix_trie.trie_digest(df)
    found = got.collect()
    expected = plain_trie(rows)
    assert len(found) == len(expected) and {tuple(r[n] for n in names) for r in found} == expected
    by_place = sorted(found, key=lambda r: r["enters"])
    assert by_place[0]["depth"] == 0 and len({r["enters"] for r in found}) == len(found)
    assert all(b["depth"] <= a["depth"] + 1 for a, b in zip(by_place, by_place[1:], strict=False))


def test_trie_of_nothing_and_of_one(spark):
    assert prefix_trie.trie_digest(spark.createDataFrame([], TALK)).count() == 0
    one = [(7, 0, "user", "a b")]
    got = prefix_trie.trie_digest(spark.createDataFrame(one, TALK)).drop("enters").collect()
    assert {tuple(r) for r in got} == plain_trie(one)


def test_list_ranking_by_levels(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "LAST", 20)
    n = 4000
    arcs = spark.range(n).select(
        (F.col("id") * 7 % n).alias("arc"), F.when(F.col("id") < n - 1, (F.col("id") + 1) * 7 % n).alias("after"), F.lit(1).alias("one").cast("long"), F.col("id").alias("saved"), F.lit(2).cast("long").alias("leaf")
    )
    got = {r["arc"]: (r["one"], r["saved"], r["leaf"]) for r in prefix_trie.ranked_list(arcs).collect()}
    assert got == {i * 7 % n: (n - i, sum(range(i, n)), 2 * (n - i)) for i in range(n)}
