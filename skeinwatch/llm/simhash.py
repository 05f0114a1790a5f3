"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint falls into segments of 22, 21 and 21 bits, each read as a word of the binary Golay code (23, 12),
whose balls of radius 3 around codewords tile all words. A segment's fuzzy keys are the codeword indices that the word
and the words one bit away decode to; there are 1 or 6 of them at most, and two words that differ in one bit always
share the plain index of one among the fuzzy keys of the other.

Pigeonhole over segments, 3 differing bits at most: sorted by errors, the two best segments have (0, 0), (0, 1) or (1, 1)
errors; the last leaves 1 error in every segment. So two fingerprints meet on a pair of segment indices when one side
gives its plain indices and the other gives plain x fuzzy and fuzzy x plain for each pair, and fuzzy x fuzzy for the
first pair. The join on these keys keeps a pair only if its real distance is at most 3: no link is lost or invented.

Null and empty texts have no words and fingerprint zero. Repeated rows share a fingerprint, and so a component. Rows
without doc_id are linked like others but never name a component; one of such rows alone has none.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinwatch.llm.common import among_maybe, maybe_among, scratch, sliced, written
from skeinwatch.llm.components import connected_components

SEED = 42
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # shift and bits of each
PAIRS = ((0, 1), (0, 2), (1, 2))
MAX_BITS = 3
GENERATOR = 0xC75  # of the Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
_CHUNK = 1 << 16


def shingle_hashes(text: str | None, size: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of size words (bytes between ASCII white space, A-Z lowered), in order, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([h(b" ".join(words), seed)], dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1]
    return np.fromiter(
        (h(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[size - 1 :].tolist(), strict=True)),
        dtype=np.uint64,
        count=len(starts),
    )


def majority(hashes: np.ndarray) -> int:
    """The 64 bits set in over half the hashes; zero of none."""
    counts = np.zeros(64, dtype=np.int64)
    for a in range(0, len(hashes), _CHUNK):
        part = np.ascontiguousarray(hashes[a : a + _CHUNK].astype(">u8"))
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame, columns: list[str], size: int = 3) -> DataFrame:
    """The named columns and fp, the SimHash of the whole text as a (signed) long."""
    n = len(columns)
    schema = docs.select(*columns).schema.add("fp", "long")

    def work(batches):
        for batch in sliced(batches):
            fps = np.array([majority(shingle_hashes(t, size)) for t in batch.column(n).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(fps.view(np.int64))], names=schema.names)

    return docs.select(*columns, F.col("text").alias("__text")).mapInArrow(work, schema)


@lru_cache(maxsize=1)
def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """The syndrome of every 12-bit high part (low 11 bits are their own), and each syndrome's error pattern."""
    high = np.zeros(1 << 12, dtype=np.int64)
    for i in range(1 << 12):
        rest = i << 11
        for bit in range(22, 10, -1):
            if rest >> bit & 1:
                rest ^= GENERATOR << bit - 11
        high[i] = rest
    single = [int(high[1 << i - 11]) if i >= 11 else 1 << i for i in range(23)]
    errors = np.zeros(1 << 11, dtype=np.int64)
    for a in range(23):
        for b in range(a, 23):
            for c in range(b, 23):
                pattern = {a, b, c}
                syndrome = mask = 0
                for i in pattern:
                    syndrome, mask = syndrome ^ single[i], mask | 1 << i
                errors[syndrome] = mask
    return high, errors


def codeword_index(words: np.ndarray) -> np.ndarray:
    """The 12 information bits of the codeword nearest to each 23-bit word."""
    high, errors = _syndromes()
    return (words ^ errors[high[words >> 11] ^ (words & 0x7FF)]) >> 11


def fuzzy_indices(words: np.ndarray, bits: int) -> np.ndarray:
    """For each word, the different indices of itself and its one-bit neighbours, in its first bits; -1 where fewer."""
    near = np.concatenate([words[:, None], words[:, None] ^ (1 << np.arange(bits))], axis=1)
    keys = np.sort(codeword_index(near), axis=1)
    keys[:, 1:][keys[:, 1:] == keys[:, :-1]] = -1
    keys = -np.sort(-keys, axis=1)
    return keys[:, : max(1, int((keys >= 0).sum(axis=1).max(initial=1)))]


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Plain keys and probe keys of fingerprints (uint64): key, fingerprint index of each."""
    words = [(fps >> np.uint64(s) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in SEGMENTS]
    plain = [codeword_index(w) for w in words]
    fuzzy = [fuzzy_indices(w, n) for w, (_, n) in zip(words, SEGMENTS, strict=True)]
    row = np.arange(len(fps))
    own, probes = [], []
    for p, (i, j) in enumerate(PAIRS):
        own.append(p << 24 | plain[i] << 12 | plain[j])
        if p == 0:
            sets = [(fuzzy[i][:, :, None], fuzzy[j][:, None, :])]
        else:
            others = np.where(fuzzy[j] == plain[j][:, None], -1, fuzzy[j])  # plain x plain once
            sets = [(fuzzy[i][:, :, None], plain[j][:, None, None]), (plain[i][:, None, None], others[:, None, :])]
        for a, b in sets:
            key = np.where((a >= 0) & (b >= 0), p << 24 | a << 12 | b, -1).reshape(len(fps), -1)
            at, _ = np.nonzero(key >= 0)
            probes.append((key[key >= 0], at))
    return np.concatenate(own), np.tile(row, len(PAIRS)), np.concatenate([k for k, _ in probes]), np.concatenate([a for _, a in probes])


def links(fps: DataFrame) -> DataFrame:
    """src > dst: every two different fingerprints of fps (one long column fp, no repeats) at MAX_BITS or less."""

    def keyed(plain: bool):
        def work(batches):
            for batch in sliced(batches, 8192):
                values = batch.column(0).to_numpy(zero_copy_only=False)
                for a in range(0, len(values), 20_000):
                    part = values[a : a + 20_000]
                    key, at, probe, of = golay_keys(part.view(np.uint64))
                    key, at = (key, at) if plain else (probe, of)
                    yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(part[at])], names=["key", "fp"])

        return work

    index = written(fps.mapInArrow(keyed(True), "key int, fp long"), "index")
    probe = maybe_among(fps.mapInArrow(keyed(False), "key int, fp long"), index, "key").where("__maybe").drop("__maybe")
    near = (F.col("a.fp") > F.col("b.fp")) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= MAX_BITS)
    met = index.alias("a").hint("merge").join(probe.alias("b"), (F.col("a.key") == F.col("b.key")) & near)
    return met.select(F.col("a.fp").alias("src"), F.col("b.fp").alias("dst")).distinct()


def simhash_components(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id: the smallest doc_id linked through near fingerprints."""
    with scratch(docs.sparkSession):
        made = written(fingerprints(docs, ["doc_id"], size), "fingerprints")
        classes = written(made.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
        found = connected_components(links(classes.select("fp")))
        labelled = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
            "fp",
            "least",
            F.coalesce("component", "fp").alias("component"),
        )
        least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
        of = labelled.join(least, "component").select("fp", "component_id")
        named = made.join(of, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
        return written(named, "fingerprint-components", keep=True)


# Near copies at a word-shingle similarity. Fingerprints of whole texts come within 3 bits for few pairs of similarity 0.8
# (about 10 bits are expected to differ). The Golay keys therefore find the closest copies, fingerprints of small shingle
# samples link large groups in few pairs, and an exact prefix join finds every link that is left between components.

BANDS, SAMPLE = 10, 3
_ODD = np.random.default_rng(5).integers(0, 2**63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Documents in the sample that tells which shingles are frequent, and how many of these are kept (their order only matters
#: for speed).
SAMPLE_DOCS, FREQUENT = 32_000, 200_000
#: Least bits of a set's parity map; larger sets have the power of two from four times their size. Two maps differ in no
#: more bits than their sets in shingles. A map of twice the bits folds into one of half by exclusive or.
PARITY = 2048
#: A shingle is frequent, too, if more rows than this of the prefix join would meet all its rows. Such shingles go to the
#: end of the order, so that what a passage shared by many documents costs grows with their number, not its square.
HEAVY = 128


def sample_fingerprints(hashes: np.ndarray) -> np.ndarray:
    """For each band, the SimHash of the 3 shingles that come first in the band's order of all shingles."""
    order = hashes[:, None] * _ODD[None, :]
    if len(hashes) > SAMPLE:
        order = np.partition(order, SAMPLE - 1, axis=0)[:SAMPLE]
    a, b, c = order[0], order[1 % len(order)], order[2 % len(order)]
    return (a & b) | (b & c) | (a & c)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


def _shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """rep (the doc_id), shingles: sorted hashes."""

    def work(batches):
        for batch in sliced(batches):
            sets = [np.unique(shingle_hashes(t, size)).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(sets)], names=["rep", "shingles"])

    schema = docs.select(F.col("doc_id").alias("rep")).schema.add("shingles", T.ArrayType(T.LongType()))
    return docs.select(F.col("doc_id").alias("rep"), "text").mapInArrow(work, schema)


def _frequent(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and sample counts of the shingles met most often in a hash sample of the documents."""
    slots = max(1, docs.count() // SAMPLE_DOCS)
    chosen = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(slots)) == 0)
    counts = _shingle_sets(chosen, size).select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("m")).where("m > 1")
    got = counts.orderBy(F.desc("m"), "shingle").limit(FREQUENT).toArrow()
    shingle, m = got.column("shingle").to_numpy(), got.column("m").to_numpy()
    at = np.argsort(shingle)
    return shingle[at], m[at]


def _first(n: int, share: float) -> int:
    return n - math.ceil(share * n - 1e-9) + 1


def _weights(shingles: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The counts of shingles among the known ones (sorted), 0 for others."""
    if not len(known):
        return np.zeros(len(shingles), dtype=np.int64)
    at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
    return np.where(known[at] == shingles, counts[at], 0)


def _parity(shingles: np.ndarray) -> np.ndarray:
    size = max(PARITY, 1 << (4 * len(shingles) - 1).bit_length())
    bits = np.bincount(shingles & (size - 1), minlength=size).astype(np.uint8) & 1
    return np.packbits(bits).view(np.int64)


class _Sketch:
    """What the stage knows of a text: two digests and the size of its shingle set, its fingerprint, sample fingerprints, and
    for the prefix join the first shingles (rare ones first), how many of them hold as the smaller set, and a parity map.

    With the shingles of all sets in one order, two sets of Jaccard similarity t share a shingle among the first
    n - ceil(2t / (1 + t) n) + 1 of the smaller and the first n - ceil(tn) + 1 of the other. Any order is exact; shingles
    frequent in the sample come last, so that few sets meet on a template.
    """

    def __init__(self, size: int, similarity: float, frequent: tuple[np.ndarray, np.ndarray]):
        self.size, self.similarity, self.frequent = size, similarity, frequent

    def __call__(self, text: str | None):
        every = shingle_hashes(text, self.size)
        own = np.unique(every)
        n = len(own)
        if not n:
            return 0, 0, 0, 0, np.zeros(0, np.int64), 0, np.zeros(0, np.int64), np.zeros(PARITY // 64, np.int64)
        with np.errstate(over="ignore"):
            mixed = np.bitwise_xor(own, own >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        x, y = int(np.bitwise_xor.reduce(own).view(np.int64)), int(mixed.sum(dtype=np.uint64).view(np.int64))
        fp = int(np.uint64(majority(every)).view(np.int64))
        shingles = own.view(np.int64)
        held = min(n, _first(n, 2 * self.similarity / (1 + self.similarity)))
        return x, y, n, fp, sample_fingerprints(own).view(np.int64), held, self.prefix(shingles), _parity(shingles)

    def prefix(self, shingles: np.ndarray, heavy: np.ndarray | None = None, weights: np.ndarray | None = None) -> np.ndarray:
        """The first shingles of a set in the order: heavy ones last by weight, then by count in the sample, then by hash."""
        keys = [shingles, _weights(shingles, *self.frequent)]
        if heavy is not None:
            at = np.argsort(heavy)
            keys.append(_weights(shingles, heavy[at], weights[at]))
        return shingles[np.lexsort(keys)][: _first(len(shingles), self.similarity)]


def _sketches(docs: DataFrame, sketch: _Sketch) -> DataFrame:
    """doc_id, x and y (digests of the shingle set), n (its size), fp, bands, held, prefix, parity: one pass over the texts."""

    def work(batches):
        for batch in sliced(batches):
            x, y, n, fp, bands, held, prefix, parity = zip(
                *map(sketch, batch.column(1).to_pylist()),
                strict=True,
            ) if batch.num_rows else ((),) * 8
            long = lambda v: pa.array(v, pa.int64())
            columns = [
                long(x),
                long(y),
                pa.array(n, pa.int32()),
                long(fp),
                _lists(list(bands)),
                pa.array(held, pa.int32()),
                _lists(list(prefix)),
                _lists(list(parity)),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    schema = docs.select("doc_id").schema.add("x", "long").add("y", "long").add("n", "integer").add("fp", "long")
    schema = schema.add("bands", T.ArrayType(T.LongType())).add("held", "integer")
    schema = schema.add("prefix", T.ArrayType(T.LongType())).add("parity", T.ArrayType(T.LongType()))
    return docs.select("doc_id", "text").mapInArrow(work, schema)


def _leaders(keyed: DataFrame, keys: list[str]) -> DataFrame:
    """a, b: each rep beside the smallest and the largest rep of its group."""
    ends = keyed.groupBy(*keys).agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")
    met = keyed.select(*keys, "rep").join(ends, keys).select("rep", F.explode(F.array("lo", "hi")).alias("end")).where("rep <> end")
    return met.select(F.least("rep", "end").alias("a"), F.greatest("rep", "end").alias("b")).distinct()


def _verified(pairs: DataFrame, docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """src, dst: the pairs a, b (written) whose whole shingle sets have the Jaccard similarity."""
    sets = _sets_of(docs, written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "asked"), size)
    one, two = (sets.select(F.col("rep").alias(x), F.col("shingles").alias(f"s{x}")) for x in ("a", "b"))
    both = F.size(F.array_intersect("sa", "sb"))
    alike = both >= F.lit(similarity) * (F.size("sa") + F.size("sb") - both)
    return pairs.join(one, "a").join(two, "b").where(alike).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def _near_fingerprints(heads: DataFrame) -> DataFrame:
    """a < b: the smallest representatives of fingerprints that the Golay keys link."""
    prints = heads.groupBy("fp").agg(F.min("rep").alias("rep"))
    one, two = prints.select(
        F.col("fp").alias("src"),
        F.col("rep").alias("a"),
    ), prints.select(F.col("fp").alias("dst"), F.col("rep").alias("b"))
    return links(prints.select("fp")).join(one, "src").join(two, "dst").select(
        F.least("a", "b").alias("a"),
        F.greatest("a", "b").alias("b"),
    )


def _first_pairs(heads: DataFrame, similarity: float) -> DataFrame:
    """a < b: candidates for links that are found cheaply: near fingerprints by the Golay keys, equal fingerprints and equal
    sample fingerprints, the latter beside the ends of their group and size range (sizes within the similarity share one of
    two ranges)."""
    ratio = F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")) / (-2 * math.log(similarity))
    ranges = F.array(
        F.struct(F.lit(0).alias("k"), F.floor(ratio).alias("r")),
        F.struct(F.lit(1).alias("k"), F.floor(ratio + 0.5).alias("r")),
    )
    banded = heads.select("rep", "n", F.posexplode("bands").alias("band", "key"))
    shared = banded.groupBy("band", "key").agg(F.count("*").alias("__m")).where("__m > 1").drop("__m")
    banded = banded.join(shared, ["band", "key"]).select("rep", "band", "key", F.explode(ranges).alias("__range"))
    pairs = _near_fingerprints(heads).unionByName(_leaders(heads.select("fp", "rep"), ["fp"]))
    return pairs.unionByName(_leaders(banded, ["band", "key", "__range"])).where("a < b").distinct()


def _prefix_rows(made: DataFrame) -> DataFrame:
    return made.select("rep", "component", "n", "held", F.posexplode("prefix").alias("pos", "shingle"))


def _shared(made: DataFrame) -> DataFrame:
    """shingle, m: those that several components have in their prefixes, and how many prefix rows they have; written."""
    ends = _prefix_rows(made).groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m"))
    return written(ends.where("lo <> hi").select("shingle", "m"), "shared")


def _meeting(made: DataFrame, shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The prefix rows (rep, component, n, held, pos, shingle) of the shared shingles (a written table), and of each shingle
    its component with most rows (main) and how many rows the others have (rest)."""
    shared, rows = shared.select("shingle"), _prefix_rows(made)
    rows = written(among_maybe(rows, shared, "shingle").join(shared, "shingle", "left_semi"), "meeting")
    each = rows.groupBy("shingle", "component").agg(F.count("*").alias("__m"))
    main = F.max_by("component", F.struct("__m", "component")).alias("main")
    return rows, written(each.groupBy("shingle").agg(main, (F.sum("__m") - F.max("__m")).alias("rest")), "mains")


def _heavy(made: DataFrame, shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The shared shingles on which more than HEAVY rows would meet all rows, and the doc_id of the representatives with any of
    them in their prefix; both written. Only shingles with more rows than that are looked at, so the rows that meet are made
    once, after the order is settled."""
    many = written(shared.where(F.col("m") > HEAVY), "many")
    if many.isEmpty():
        return many.select("shingle"), made.select(F.col("rep").alias("doc_id")).limit(0)
    rows, main = _meeting(made, many)
    heavy = written(main.where(F.col("rest") > HEAVY).select("shingle"), "heavy")
    return heavy, written(rows.join(heavy, "shingle", "left_semi").select(F.col("rep").alias("doc_id")).distinct(), "holders")


def _holders(made: DataFrame, shingles: DataFrame) -> DataFrame:
    """doc_id of the representatives with any of the shingles (a written table) in their prefix; written."""
    rows = made.select(F.col("rep").alias("doc_id"), F.explode("prefix").alias("shingle"))
    found = among_maybe(rows, shingles, "shingle").join(shingles, "shingle", "left_semi")
    return written(found.select("doc_id").distinct(), "holders")


def _sets_of(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """The whole shingle sets (rep, shingles) of the documents with these ids (a written table); written."""
    likely = maybe_among(docs.select("doc_id", "text"), ids, "doc_id").where("__maybe").drop("__maybe")
    return written(_shingle_sets(likely.join(ids, "doc_id", "left_semi"), size), "sets")


def _reordered(made: DataFrame, docs: DataFrame, heavy: DataFrame, holders: DataFrame, sketch: _Sketch) -> DataFrame:
    """made with new prefixes for an order in which the heavy shingles come last, and with them all other shingles that more
    than HEAVY of the documents concerned (holders) have (a passage's shingles come up together).

    A prefix without any of these stays as it is in the new order, so that only the others are made anew.
    """
    sets = _sets_of(docs, holders, sketch.size)
    counts = sets.select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("weight")).where(F.col("weight") > HEAVY)
    late = counts.unionByName(heavy.withColumn("weight", F.lit(1).cast("long"))).groupBy("shingle").agg(F.max("weight").alias("weight"))
    late = written(late, "late")
    everyone = _holders(made, late.select("shingle"))
    sets = sets.unionByName(_sets_of(docs, written(everyone.join(holders, "doc_id", "left_anti"), "holders"), sketch.size))
    rows = sets.select("rep", F.explode("shingles").alias("shingle"))
    rows = among_maybe(rows, late.select("shingle"), "shingle").join(late, "shingle")
    own = rows.groupBy("rep").agg(F.collect_list("shingle").alias("late"), F.collect_list("weight").alias("weights"))

    def work(batches):
        for batch in sliced(batches):
            part = lambda i, j: batch.column(i)[j].values.to_numpy()  # noqa: B023, E731
            prefixes = [sketch.prefix(*(part(i, j) for i in (1, 2, 3))) for j in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(prefixes)], names=["rep", "prefix"])

    schema = made.select("rep", "prefix").schema
    anew = written(sets.join(own, "rep").select("rep", "shingles", "late", "weights").mapInArrow(work, schema), "prefixes")
    marked = maybe_among(made, anew.select("rep"), "rep")
    likely = marked.where("__maybe").join(anew.withColumnRenamed("prefix", "__p"), "rep", "left")
    likely = likely.withColumn("prefix", F.coalesce("__p", "prefix")).select(*made.columns)
    return marked.where("not __maybe").select(*made.columns).unionByName(likely)


def _prefix_pairs(made: DataFrame, docs: DataFrame, sketch: _Sketch) -> DataFrame:
    """a < b: every two representatives of different components that can have the similarity.

    made: rep, component, n, held, prefix, parity. Shingles that only one component has in its prefixes are left out first. On
    each of the rest the rows of all components but its largest meet all rows; two rows of one component need not meet, so
    a large group that is linked already costs what it has rows.
    """
    similarity = sketch.similarity
    shared = _shared(made)
    heavy, holders = _heavy(made, shared)
    if not heavy.isEmpty():
        made = written(_reordered(made, docs, heavy, holders, sketch), "prefixes")
        shared = _shared(made)
    rows, main = _meeting(made, shared)
    a, b = rows.join(main, "shingle").where("component <> main").alias("a"), rows.alias("b")
    col = lambda side, name: F.col(f"{side}.{name}")

    def fits(s: str, t: str):
        """s is the smaller set (or as large), its row is in the shorter prefix, and what is left can overlap enough."""
        left = F.least(col(s, "n") - col(s, "pos"), col(t, "n") - col(t, "pos"))
        enough = left + 1e-6 >= F.lit(similarity / (1 + similarity)) * (col(s, "n") + col(t, "n"))
        return (col(s, "n") <= col(t, "n")) & (col(s, "pos") < col(s, "held")) & (
            col(s, "n") + 1e-6 >= F.lit(similarity) * col(t, "n")
        ) & enough

    met = a.join(
        b,
        (col("a", "shingle") == col("b", "shingle")) & (col("a", "component") != col("b", "component")) & (fits("a", "b") | fits("b", "a")),
    )
    pairs = met.select(F.least("a.rep", "b.rep").alias("a"), F.greatest("a.rep", "b.rep").alias("b")).distinct()
    maps = lambda side: made.select(F.col("rep").alias(side), F.col("n").alias(f"n{side}"), F.col("parity").alias(f"p{side}"))
    # Sizes within the similarity have maps of equal length, or one of twice the other's.
    least = F.least(F.size("pa"), F.size("pb"))
    folded = lambda p: F.when(F.size(p) > least, F.zip_with(F.slice(p, F.lit(1), least), F.slice(p, least + 1, least), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(p))
    differ = F.aggregate(
        F.zip_with(folded("pa"), folded("pb"), lambda x, y: F.bit_count(x.bitwiseXOR(y))),
        F.lit(0),
        lambda total, bits: total + bits,
    )
    alike = differ <= F.lit((1 - similarity) / (1 + similarity)) * (F.col("na") + F.col("nb")) + 1e-6
    return pairs.join(maps("a"), "a").join(maps("b"), "b").where(alike).select("a", "b").distinct()


def _representatives(made: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of made whose doc_id stands for a class, as rep. Most are known by a bitmap of the copies' ids, unshuffled."""
    copies = made.select("doc_id", "x", "y", "n").join(classes, ["x", "y", "n"]).where("doc_id <> rep").select("doc_id")
    copies = written(copies, "copies")
    marked = maybe_among(made, copies, "doc_id")
    likely = marked.where("__maybe").join(copies, "doc_id", "left_anti").select(*made.columns)
    return marked.where("not __maybe").select(*made.columns).unionByName(likely).withColumnRenamed("doc_id", "rep")


def _one_row_an_id(docs: DataFrame) -> DataFrame:
    """doc_id, text: one row of each doc_id, the smallest text of those that repeat; only the texts of these are shuffled."""
    texts = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    again = written(texts.groupBy("doc_id").agg(F.count("*").alias("m")).where("m > 1").select("doc_id"), "repeated")
    if again.isEmpty():
        return texts
    marked = maybe_among(texts, again, "doc_id")
    likely = marked.where("__maybe").groupBy("doc_id").agg(F.min("text").alias("text"))
    return marked.where("not __maybe").select("doc_id", "text").unionByName(likely)


def near_duplicate_groups(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, group_id (the smallest doc_id of its group): documents linked by shingle-set similarity.

    Documents of equal shingle sets are one class; its smallest doc_id stands for it. First links are sought cheaply
    (_first_pairs). Then all pairs of classes that these links leave in different components meet by prefix filter, and
    those whose parity maps prove them unlike are left out, so no link between components is lost. Every candidate pair is
    verified by exact Jaccard similarity of the whole shingle sets. Rows without doc_id take no part; rows that repeat one
    are one document, of the smallest text among them.
    """
    docs = _one_row_an_id(docs)
    sketch = _Sketch(size, similarity, _frequent(docs, size))
    made = written(_sketches(docs, sketch), "sketches")
    classes = written(made.groupBy("x", "y", "n").agg(F.min("doc_id").alias("rep")), "classes")
    reps = _representatives(made, classes)
    heads = written(reps.select("rep", "n", "fp", "bands"), "heads")
    first = written(_verified(written(_first_pairs(heads, similarity), "pairs"), docs, size, similarity), "links")
    of = connected_components(first).withColumnRenamed("node", "rep")
    moved = written(of.where("component <> rep"), "moved")
    of = written(
        heads.select("rep").join(moved, "rep", "left").select("rep", F.coalesce("component", "rep").alias("component")),
        "components",
    )

    marked = maybe_among(reps.drop("x", "y", "fp", "bands"), moved, "rep")
    likely = marked.where("__maybe").join(moved, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    parts = marked.where("not __maybe").withColumn("component", F.col("rep")).unionByName(likely).drop("__maybe")
    candidates = written(_prefix_pairs(written(parts, "prefixes"), docs, sketch), "pairs")
    rest = _verified(candidates, docs, size, similarity)
    side = lambda name, out: of.select(F.col("rep").alias(name), F.col("component").alias(out))
    rest = rest.join(side("src", "__a"), "src").join(side("dst", "__b"), "dst").select(F.col("__a").alias("src"), F.col("__b").alias("dst"))
    return made.select("doc_id", "x", "y", "n").join(
        _grouped(classes, of, connected_components(rest)),
        ["x", "y", "n"],
    ).select("doc_id", "group_id")


def _grouped(classes: DataFrame, of: DataFrame, groups: DataFrame) -> DataFrame:
    """x, y, n, group_id: classes by their component, and these by the group of components that later links join."""
    joined = groups.select(F.col("node").alias("component"), F.col("component").alias("group_id"))
    named = of.join(joined, "component", "left").select("rep", F.coalesce("group_id", "component").alias("group_id"))
    return classes.join(named, "rep").select("x", "y", "n", "group_id")


def deduplicated(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with the smallest doc_id of each group of near duplicates.

    Documents are known by doc_id: rows without one stay, and rows that repeat a doc_id stay or go together. Null and
    empty texts are one group.
    """
    with scratch(docs.sparkSession):
        groups = near_duplicate_groups(docs, size, similarity)
        gone = written(groups.where("doc_id <> group_id").select("doc_id").distinct(), "duplicates", keep=True)
    marked = maybe_among(docs, gone, "doc_id")
    likely = marked.where("__maybe").join(gone, "doc_id", "left_anti").select(*docs.columns)
    return marked.where("not __maybe").select(*docs.columns).unionByName(likely)
