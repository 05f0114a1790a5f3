"""Prefix trie of conversations, and sums over its subtrees by an Euler tour.

A conversation's first d turns are named by sums over them: each turn adds words that depend on its place and its text, so
the names of all prefixes are running sums, which need no task to hold a conversation. Equal names are one node; that all
turns of a node are the same is checked as it is made, so by induction equal names are equal prefixes (else the job fails).
A node goes by its smallest conversation and its depth.

Each node has an arc in and an arc out; the arc after each follows from the node's first child, its next sibling or its
parent. The tour is ranked as a list: one arc in RULERS, chosen by hash, is a ruler, pointers double until each meets the
next ruler, and the rulers make a shorter list, until at most LAST arcs are left, which one task walks. Sums from each arc to
the end, level by level back, give every subtree's as the difference of its two arcs.

Null roles and texts are empty; turns stand by turn (null first), equal ones by a digest of role and text. Rows without a conv_id belong to no
conversation and are left out. An empty table has no node, not even a root.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinwatch.functions.ranked import numbered
from skeinwatch.llm.common import field, scratch, word_count, written

RULERS = 16
LAST = 1 << 14
STRETCH = 1024  # turns of a conversation whose sums are taken in one window
JOINED = 256  # ids a piece of a joined list
NAME = ["__a", "__b", "__c", "__d"]  # four sums of 32-bit words


def _half(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 15), 16, 10).cast("long")


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, n (place from 0), t1, t2 (120 bits of a digest of role and text), words: narrow rows, numbered."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.sha2(F.concat(field(role), field(text)), 256)
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", said.alias("said"), word_count(text).alias("words"),
    )
    rows = rows.select("conv_id", "turn", _half(F.col("said"), 1).alias("t1"), _half(F.col("said"), 16).alias("t2"), "words")
    return numbered(written(rows, "said"), ["turn", "t1", "t2"], "n", ["conv_id"]).drop("turn")


def rebuilt(said: DataFrame, head: Column, base: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with another one's turns: (conv_id, d, t1, t2, words, last) rows, and conv_id, n_turns.

    said: turns(). Of conversation `base` (a column of conv_id) the first `head` turns (at most `most`; all if fewer) come
    first, then the own turns after the first `head`.
    """
    convs = said.groupBy("conv_id").agg(F.count("*").alias("own")).withColumn("head", head).withColumn("base", base)
    heads = said.where(F.col("n") < most).select(F.col("conv_id").alias("base"), F.col("n").alias("m"), "t1", "t2", "words")
    sizes = heads.groupBy("base").agg(F.count("*").alias("has"))
    convs = convs.join(sizes, "base", "left").withColumn("led", F.least("head", F.coalesce("has", F.lit(0))))
    n_turns = F.col("led") + F.greatest(F.col("own") - F.col("head"), F.lit(0))
    convs = convs.select("conv_id", "base", "head", "led", n_turns.alias("n_turns"))
    first = convs.join(heads, "base").where(F.col("m") < F.col("led")).select("conv_id", (F.col("m") + 1).alias("d"), "t1", "t2", "words", "n_turns")
    rest = said.join(convs.drop("base"), "conv_id").where(F.col("n") >= F.col("head"))
    rest = rest.select("conv_id", (F.col("n") - F.col("head") + F.col("led") + 1).alias("d"), "t1", "t2", "words", "n_turns")
    rows = first.unionByName(rest)
    return rows.withColumn("last", F.col("d") == F.col("n_turns")).drop("n_turns"), convs.select("conv_id", "n_turns")


def _named(rows: DataFrame) -> DataFrame:
    """rows with the name of their prefix in NAME and of the one before in NAME with an underscore more."""
    hashes = [F.xxhash64("t1", "t2", "d", F.lit(salt)) for salt in (1, 2)]
    words = [w for h in hashes for w in (F.shiftrightunsigned(h, 32), h.bitwiseAND(0xFFFFFFFF))]
    rows = rows.withColumns(dict(zip((f"__w{c}" for c in NAME), words, strict=True))).withColumn("__at", F.floor((F.col("d") - 1) / STRETCH))
    rows = written(rows, "turns")
    before = Window.partitionBy("conv_id").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    # of long conversations only, what the stretches before add
    long = rows.join(rows.where("__at > 0").select("conv_id").distinct(), "conv_id", "left_semi")
    whole = long.groupBy("conv_id", "__at").agg(*(F.sum(f"__w{c}").alias(f"__s{c}") for c in NAME))
    past = whole.select("conv_id", "__at", *(F.sum(f"__s{c}").over(before).alias(f"__p{c}") for c in NAME)).where("__at > 0")
    upto = Window.partitionBy("conv_id", "__at").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *(F.sum(f"__w{c}").over(upto).alias(f"__u{c}") for c in NAME)).join(past, ["conv_id", "__at"], "left")
    name = {c: F.col(f"__u{c}") + F.coalesce(f"__p{c}", F.lit(0)) for c in NAME}
    own = [name[c].alias(c) for c in NAME] + [(name[c] - F.col(f"__w{c}")).alias(f"_{c}") for c in NAME]
    return rows.select("conv_id", "d", "t1", "t2", "words", "last", *own)


def _digests(parts) -> object:
    """Sorted pieces of joined ids, hashed as they come: a task holds one batch, whatever a node's list is long."""
    key, running = None, None
    for batch in parts:
        done = []
        for row in batch.to_pylist():
            at = (row["conv_id"], row["depth"])
            if at != key:
                if running is not None:
                    done.append((*key, running.hexdigest()))
                key, running = at, hashlib.sha256()
            else:
                running.update(b",")
            running.update(row["ids"].encode())
        if done:
            yield _batch(done)
    if running is not None:
        yield _batch([(*key, running.hexdigest())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    conv, depth, digest = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(depth, pa.int64()), pa.array(digest, pa.string())], ["conv_id", "depth", "ends_sha256"])


def list_digests(ends: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256: SHA-256 of each node's member ids (column `id`), ascending and comma-joined.

    Ids are numbered within their node and joined in pieces by different tasks; a node of one piece is hashed there and
    then, those of more are hashed piece after piece (the digest of a string is sequential).
    """
    key = ["conv_id", "depth"]
    piece = numbered(ends, ["id"], "__n", key).groupBy(*key, F.floor(F.col("__n") / JOINED).alias("piece"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",")
    pieces = written(piece.agg(ids.alias("ids")), "pieces")
    many = pieces.where("piece > 0").select(*key).distinct()
    alone = pieces.join(many, key, "left_anti").select(*key, F.sha2("ids", 256).alias("ends_sha256"))
    rest = pieces.join(many, key, "left_semi").repartition(*key).sortWithinPartitions(*key, "piece")
    return alone.unionByName(rest.mapInArrow(_digests, "conv_id long, depth long, ends_sha256 string"))


def trie(rows: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node: its number, by depth, parent and conv_id; conv_id, depth, parent_conv_id, n_convs, words), and
    conv_id, depth, id: the node at which each conversation ends."""
    named = _named(rows)
    end = ["d", *NAME]
    root = convs.select("conv_id", F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("t1"), F.lit(0).cast("long").alias("t2"), F.lit(0).cast("long").alias("words"), (F.col("n_turns") == 0).alias("last"), *(F.lit(0).cast("long").alias(c) for c in [*NAME, *(f"_{c}" for c in NAME)]))
    named = written(named.unionByName(root), "prefixes")
    same = (F.min("t1") == F.max("t1")) & (F.min("t2") == F.max("t2"))
    nodes = named.groupBy(*end).agg(
        F.min("conv_id").alias("own"), F.count("*").alias("n_convs"), F.min("words").alias("words"), *(F.min(f"_{c}").alias(f"_{c}") for c in NAME),
        F.when(same, True).otherwise(F.raise_error(F.lit("two prefixes of one name"))).alias("sure"),
    ).where("sure").drop("sure")
    nodes = written(nodes, "nodes")
    over = nodes.select((F.col("d") + 1).alias("d"), *(F.col(c).alias(f"_{c}") for c in NAME), F.col("own").alias("parent_conv_id"))
    made = nodes.join(over, ["d", *(f"_{c}" for c in NAME)], "left")
    made = made.select(F.col("own").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", "n_convs", "words")
    ends = named.where("last").join(nodes.select(*end, "own"), end).select(F.col("own").alias("conv_id"), F.col("d").alias("depth"), F.col("conv_id").alias("id"))
    return numbered(made, ["depth", "parent_conv_id", "conv_id"], "node"), ends


def tour(nodes: DataFrame) -> DataFrame:
    """arc, after (null at the end), leaf, saved, one: the Euler tour's arcs. A node's arc in is 2 * node, its arc out one more.

    A node's children have consecutive numbers, so the arc after one child's exit is the next number's entry, but for the
    last child, which leads out of the parent. nodes: node, n_children, first, last, saved.
    """
    out = nodes.where("n_children > 0").select(F.col("last").alias("node"), F.col("node").alias("up"))
    both = nodes.join(out, "node", "left")
    none = F.lit(0).cast("long")
    enter = F.struct(
        (F.col("node") * 2).alias("arc"), F.coalesce(F.col("first") * 2, F.col("node") * 2 + 1).alias("after"),
        (F.col("n_children") == 0).cast("long").alias("leaf"), "saved",
    )
    beside = F.when(F.col("up").isNotNull(), F.col("up") * 2 + 1).when(F.col("depth") > 0, (F.col("node") + 1) * 2)
    leave = F.struct((F.col("node") * 2 + 1).alias("arc"), beside.alias("after"), none.alias("leaf"), none.alias("saved"))
    return both.select(F.explode(F.array(enter, leave)).alias("__x")).select("__x.*", F.lit(1).cast("long").alias("one"))


WEIGHTS = ["leaf", "saved", "one"]


def _ruler(arc: Column, level: int) -> Column:
    return F.pmod(F.xxhash64(arc, F.lit(level)), F.lit(RULERS)) == 0


def _to_rulers(arcs: DataFrame, level: int) -> DataFrame:
    """arcs with `after` moved on to the next ruler (or to the end), and the weights of all arcs on the way added."""
    stands = lambda: F.col("after").isNull() | _ruler(F.col("after"), level)
    while True:
        seen = Observation()
        arcs = written(arcs.observe(seen, F.count_if(~stands()).alias("open")), "arcs")
        if not seen.get["open"]:
            return arcs
        step = arcs.select(F.col("arc").alias("__at"), F.col("after").alias("__after"), *(F.col(w).alias(f"__{w}") for w in WEIGHTS))
        moved = arcs.where(~stands()).join(step, F.col("after") == F.col("__at"))
        moved = moved.select("arc", F.col("__after").alias("after"), *((F.col(w) + F.col(f"__{w}")).alias(w) for w in WEIGHTS))
        arcs = arcs.where(stands()).unionByName(moved)


def _walked(batches) -> object:
    """Sums to the end of a list of at most LAST arcs."""
    rows = {r["arc"]: r for b in batches for r in b.to_pylist()}
    heads = set(rows) - {r["after"] for r in rows.values()}
    order, at = [], next(iter(heads), None)
    while at is not None:
        order.append(at)
        at = rows[at]["after"]
    sums, total = [], dict.fromkeys(WEIGHTS, 0)
    for arc in reversed(order):
        total = {w: total[w] + rows[arc][w] for w in WEIGHTS}
        sums.append({"arc": arc, **total})
    if sums:
        yield pa.RecordBatch.from_pylist(sums, pa.schema([(c, pa.int64()) for c in ["arc", *WEIGHTS]]))


def ranked_list(arcs: DataFrame) -> DataFrame:
    """arc and, for each weight, its sum from that arc (counted) to the end of the list. arcs: arc, after, the weights."""
    levels = []
    start = arcs
    while True:
        level = len(levels)
        held = _to_rulers(start, level)
        levels.append(held)
        # the rulers' own list; the first arc of all, which nothing leads to, isn't needed in it
        start = held.where(_ruler(F.col("arc"), level))
        seen = Observation()
        start = written(start.observe(seen, F.count("*").alias("n")), "rulers")
        if seen.get["n"] <= LAST:
            break
    sums = start.coalesce(1).mapInArrow(_walked, ", ".join(f"{c} long" for c in ["arc", *WEIGHTS]))
    for held in reversed(levels):
        further = sums.select(F.col("arc").alias("__at"), *(F.col(w).alias(f"__{w}") for w in WEIGHTS))
        joined = held.join(further, F.col("after") == F.col("__at"), "left")
        sums = written(joined.select("arc", *((F.col(w) + F.coalesce(f"__{w}", F.lit(0))).alias(w) for w in WEIGHTS)), "sums")
    return sums


def prefix_trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, enters (the place of the
    node's first arc in the tour): a row for each prefix. rows, convs: as rebuilt() gives them."""
    nodes, ends = trie(rows, convs)
    nodes = written(nodes, "nodes")
    below = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
    below = below.agg(F.count("*").alias("n_children"), F.min("node").alias("first"), F.max("node").alias("last"))
    nodes = nodes.join(below, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    seen = Observation()
    saved = (F.col("n_convs") - 1) * F.col("words")
    nodes = written(nodes.withColumn("saved", saved).observe(seen, F.count("*").alias("n")), "nodes")
    sums = ranked_list(tour(nodes))
    sign = F.when(F.col("arc") % 2 == 0, 1).otherwise(-1)
    inside = sums.groupBy(F.floor(F.col("arc") / 2).alias("node")).agg(*(F.sum(sign * F.col(w)).alias(n) for w, n in (("leaf", "n_leaves"), ("saved", "saved_tokens"))), F.max("one").alias("__left"))
    made = nodes.join(inside, "node").join(list_digests(ends), ["conv_id", "depth"], "left")
    return made.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), (F.lit(2 * seen.get["n"]) - F.col("__left")).alias("enters"),
    )


def trie_digest(conversations: DataFrame) -> DataFrame:
    """The trie of conversations of which each begins with up to three turns of one of the 20 around it."""
    conv = F.col("conv_id")
    with scratch(conversations.sparkSession):
        said = turns(conversations)
        rows, convs = rebuilt(said, F.crc32(conv.cast("string")) % 4, conv - F.pmod(conv, F.lit(20)), 3)
        return written(prefix_trie(rows, convs), "trie", keep=True)
