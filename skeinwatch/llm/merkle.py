"""Merkle manifest of a dataset: a digest a row, a tree a group, a tree over the groups' roots, and a proof for every row.

Rows are numbered within their group by range partitions. An aligned block of BLOCK consecutive nodes keeps each of its
levels as one hex string: fixed-width substrings of a level are hashed to the level above, and the substrings that flank a
node in its run are its sibling segments. What is left of each block is a node of the next table of blocks, until every
group has one node; the groups' roots are then the nodes of one more tree. On the way down each block gets the segments
above its own top before it is spread over its members, so only a row a block carries them through a shuffle and no table
holds the proofs of all rows.

A tree's node is the sha256 (lowercase hex) of its children's hex text, RUN of them or fewer at the end of a level, even one.
Null groups are one group, before all others. Rows with one group and order value stand by their digest, repeated rows
anyhow: they are alike. A group of one row has its digest as root; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from skeinwatch.functions.ranked import numbered
from skeinwatch.llm.common import field, written

WIDTH, RUN, STEPS = 64, 3, 4
BLOCK = RUN**STEPS
SEGMENTS = "array<struct<left:string,right:string>>"


def row_digest(columns: list[Column]) -> Column:
    """sha256 of columns, each `-` if null, else its UTF-8 byte count, a colon and its text."""
    return F.sha2(F.concat(*(field(c) for c in columns)), 256)


def parents(level: Column) -> Column:
    """The level above a level string."""
    runs = F.ceil(F.length(level) / (WIDTH * RUN))
    each = F.transform(F.sequence(F.lit(0), runs - 1), lambda i: F.sha2(F.substring(level, i * (WIDTH * RUN) + 1, F.lit(WIDTH * RUN)), 256))
    return F.array_join(each, "")


def segments(levels: Column, at: Column) -> Column:
    """What flanks a block's node in its run on each level but the last, from the node's place in the block."""

    def one(level, step):
        place = F.floor(at / F.pow(F.lit(RUN), step))
        run = F.floor(place / RUN) * RUN
        left = F.substring(level, run * WIDTH + 1, (place - run) * WIDTH)
        right = F.substring(level, (place + 1) * WIDTH + 1, (run + RUN - place - 1) * WIDTH)
        return F.struct(left.alias("left"), right.alias("right"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), one)


def folded(digest: Column, path: Column) -> Column:
    """The root that a node's digest and its segments lead to."""
    return F.aggregate(path, digest, lambda below, s: F.sha2(F.concat(s["left"], below, s["right"]), 256))


def proof_text(path: Column) -> Column:
    """All siblings on a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def _levels(members: Column, block: Column) -> Column:
    """A block's level strings, from its members' digests to its last node.

    A first block that isn't full is its group's only one and ends at one node; a full one ends there after all steps anyway.
    """
    leaf = F.array_join(F.transform(members, lambda m: m["digest"]), "")
    whole = (block > 0) | (F.size(members) == BLOCK)

    def step(levels, _):
        up = F.concat(levels, F.array(parents(F.element_at(levels, -1))))
        return F.when(whole | (F.length(F.element_at(levels, -1)) > WIDTH), up).otherwise(levels)

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.array(leaf), step)


def _trees(nodes: DataFrame) -> list[DataFrame]:
    """Tables of blocks, from the leaves up to one block a group: __group, __block, members, levels.

    nodes: __group, __n (gapless from 0 in each group), digest, kept (anything that stays with a leaf).
    """
    tables = []
    while True:
        member = F.struct("__n", "digest", "kept")
        blocks = nodes.groupBy("__group", F.floor(F.col("__n") / BLOCK).alias("__block"))
        blocks = blocks.agg(F.array_sort(F.collect_list(member)).alias("members"))
        seen = Observation()
        made = blocks.withColumn("levels", _levels(F.col("members"), F.col("__block")))
        made = written(made.observe(seen, F.max("__block").alias("last")), "blocks")
        tables.append(made)
        if not seen.get["last"]:
            return tables
        nodes = made.select("__group", F.col("__block").alias("__n"), F.element_at("levels", -1).alias("digest"), F.lit(0).alias("kept"))


def _roots(tables: list[DataFrame]) -> DataFrame:
    return tables[-1].select("__group", F.element_at("levels", -1).alias("root"))


def _spread(blocks: DataFrame, carried: list[str]) -> DataFrame:
    """__group, __n, kept, digest, path and what is carried for each member of blocks with `above`, the segments over them."""
    m = F.col("__m")
    rows = blocks.select("__group", "levels", "above", *carried, F.explode("members").alias("__m"))
    path = F.concat(segments(F.col("levels"), F.pmod(m["__n"], F.lit(BLOCK))), F.col("above"))
    return rows.select("__group", m["__n"].alias("__n"), m["kept"].alias("kept"), m["digest"].alias("digest"), path.alias("path"), *carried)


def _proofs(tables: list[DataFrame], tops: DataFrame, carried: list[str]) -> DataFrame:
    """A row a leaf with its whole path. tops: __group, above and what is carried, a row a group."""
    over = tops.withColumn("__block", F.lit(0).cast("long"))
    for blocks in reversed(tables[1:]):
        over = _spread(blocks.join(over, ["__group", "__block"]), carried).select("__group", F.col("__n").alias("__block"), F.col("path").alias("above"), *carried)
    return _spread(tables[0].join(over, ["__group", "__block"]), carried)


def manifest(rows: DataFrame, group: str, order: str, digest: Column, kept: dict[str, Column]) -> DataFrame:
    """kept, leaf, subroot, root, path: a row for each row, path being the sibling segments up to the root.

    digest: a row's digest. kept: named columns that stay with a row. The tables of blocks are written; jobs run as this
    is called.
    """
    # "-" stands before "=", so null groups come first and others in the order of their bytes
    name = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    leaves = rows.select(
        name.alias("__group"), F.col(order).alias("__order"), digest.alias("digest"), F.struct(*(c.alias(n) for n, c in kept.items())).alias("kept")
    )
    leaves = numbered(written(leaves, "leaves"), ["__order", "digest"], "__n", ["__group"]).drop("__order")
    tables = _trees(leaves)
    own = _roots(tables).select(F.lit("").alias("__group"), F.col("__group").alias("kept"), F.col("root").alias("digest"))
    over = _trees(numbered(own, ["kept"], "__n"))
    # one row by construction: the root of roots
    root = _roots(over).select("__group", "root", F.array().cast(SEGMENTS).alias("above"))
    tops = _proofs(over, root, ["root"]).select(F.col("kept").alias("__group"), F.col("path").alias("above"), F.col("digest").alias("subroot"), "root")
    made = _proofs(tables, tops, ["subroot", "root"])
    return made.select("kept.*", F.col("digest").alias("leaf"), "subroot", "root", "path")


def manifest_digest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of documents by source.

    In every second document (by the crc32 of its id) the line feeds of the text are deleted before its root is computed
    again from its own digest and its siblings; a null doc_id is none of these.
    """
    names = ["doc_id", "source", "lang", "n_chars"]
    plain = row_digest([F.col(c) for c in [*names, "text"]])
    cut = row_digest([*(F.col(c) for c in names), F.replace(F.col("text"), F.lit("\n"), F.lit(""))])
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False)) & F.coalesce(F.instr("text", "\n") > 0, F.lit(False))
    rows = docs.select(*names, "text").withColumn("__other", F.when(chosen, cut))
    made = manifest(rows, "source", "doc_id", plain, {"doc_id": F.col("doc_id"), "other": F.col("__other")})
    made = made.withColumn("folded_root", folded(F.coalesce("other", "leaf"), F.col("path")))
    return made.select(
        "doc_id", "leaf", "subroot", "root",
        F.sha2(proof_text(F.col("path")), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
