"""Language ID by rank-order n-gram profiles and out-of-place distance.

A language's profile is its most frequent character 1- to 3-grams in rank order. A document is given the language
whose profile is nearest: each of the document's own most frequent n-grams adds the difference of its two ranks, or the
profile's length where the profile lacks it.

Null, empty and letterless texts get `und` with score 0; so does every text when nothing could be learned. Ties between
languages go to the first in alphabetical order, ties between n-grams to the smaller code points. Repeated rows are
scored each on its own; other columns aren't read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinwatch.llm.common import sliced, utf8_slices

TOP = 300
TRAIN_PER_LANG = 2000
LANGUAGES = 1000
SLICE_CHARS = 250_000
_CHAR, _DOC = 18, 8  # bits of a letter's index (enough for all of Unicode's letters) and of a text's index within a slice


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def ranked_grams(texts: list[str | None], top: int | None):
    """Text index, n-gram code, rank and count of each text's n-grams, most frequent first.

    A code holds three code points of 21 bits, zero-filled; a word's ends count as the letter U+0020. At most 255 texts.
    """
    cps, owner = [np.array([32], dtype=np.uint32)], [np.zeros(1, dtype=np.int64)]
    for i, text in enumerate(texts):
        if text:
            own = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
            cps += [own, np.array([32], dtype=np.uint32)]
            owner.append(np.full(len(own) + 1, i, dtype=np.int64))
    c, doc = np.concatenate(cps), np.concatenate(owner)
    c = np.where(_letters()[c], c, 32).astype(np.int64)
    keep = np.ones(len(c), dtype=bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    c, doc = c[keep], doc[keep]
    seen = np.zeros(0x110000, dtype=bool)
    seen[c] = True
    alphabet = np.flatnonzero(seen)
    index = np.zeros(0x110000, dtype=np.int64)
    index[alphabet] = np.arange(1, len(alphabet) + 1)
    x, space = index[c], c == 32
    one = x[~space] << 2 * _CHAR | doc[~space] << 3 * _CHAR
    two_at = (doc[:-1] == doc[1:]) | space[:-1]
    two = (x[:-1] << 2 * _CHAR | x[1:] << _CHAR | doc[1:] << 3 * _CHAR)[two_at]
    three_at = ~space[1:-1] & (doc[1:-1] == doc[2:])
    three = (x[:-2] << 2 * _CHAR | x[1:-1] << _CHAR | x[2:] | doc[1:-1] << 3 * _CHAR)[three_at]
    keys = np.concatenate([one, two, three])
    keys.sort()
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    grams, counts = keys[first], np.diff(first, append=len(keys))
    of = grams >> 3 * _CHAR
    less = counts.max(initial=0) - counts
    if len(grams) >= 2**27 or less.max(initial=0) >= 2**24:  # too many or too far apart for one key
        order = np.lexsort((-counts, of))
    else:
        order = np.argsort(of << 51 | less << 27 | np.arange(len(grams)))
    grams, counts, of = grams[order], counts[order], of[order]
    begins = np.flatnonzero(np.diff(of, prepend=-1))
    rank = np.arange(len(of)) - np.repeat(begins, np.diff(begins, append=len(of)))
    if top is not None:
        kept = rank < top
        grams, counts, of, rank = grams[kept], counts[kept], of[kept], rank[kept]
    letters = np.concatenate([[0], alphabet])
    mask = 2**_CHAR - 1
    a, b, d = grams >> 2 * _CHAR & mask, grams >> _CHAR & mask, grams & mask
    return of, letters[a] << 42 | letters[b] << 21 | letters[d], rank, counts


def word_pieces(text: str, size: int):
    """Runs of about size characters that end where a word does, so that their n-grams together are the text's."""
    a = 0
    while a < len(text):
        b = min(len(text), a + size)
        while b < len(text) and text[b].isalpha():
            b += 1
        yield text[a:b]
        a = b


def ranked_long(text: str, top: int | None):
    """ranked_grams of one text, in pieces, so that its arrays stay small however long it is."""
    code, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for piece in word_pieces(text, SLICE_CHARS):
        _, more, _, counts = ranked_grams([piece], None)
        code, at = np.unique(np.concatenate([code, more]), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([n, counts]), minlength=len(code)).astype(np.int64)
    order = np.lexsort((code, -n))[:top]
    return np.zeros(len(order), np.int64), code[order], np.arange(len(order)), n[order]


def training_rows(docs: DataFrame, usable: Column, per_lang: int = TRAIN_PER_LANG) -> DataFrame:
    """At most about per_lang labelled rows of each language, drawn by a hash of doc_id (the documented bound).

    Of more than LANGUAGES labels the most frequent ones are learned.
    """
    labelled = docs.where(usable & F.col("lang").isNotNull())
    counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()  # a row a language
    if not counts:
        return labelled.select("lang", "text")
    share = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], min(1.0, per_lang / r["count"]))))
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("train")), F.lit(1_000_000)) / 1e6
    return labelled.where((draw < share[F.col("lang")]) & F.col("text").isNotNull()).select("lang", "text")


def learn(rows: DataFrame, top: int = TOP) -> dict[str, list[int]]:
    """Each language's top n-gram codes, most frequent first. What reaches the driver is top codes a language."""

    def count(batches):
        for batch in sliced(batches, 4096):
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in dict.fromkeys(langs):
                own = [t for l, t in zip(langs, texts, strict=True) if l == lang]
                for a, b in utf8_slices(own, SLICE_CHARS):
                    _, code, _, n = ranked_long(" ".join(t for t in own[a:b] if t), None)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(code), pa.string()), pa.array(code, pa.int64()), pa.array(n, pa.int64())],
                        names=["lang", "gram", "n"],
                    )

    counted = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    out: dict[str, list[int]] = {}
    for row in best.orderBy("lang", "rank").collect():
        out.setdefault(row["lang"], []).append(row["gram"])
    return out


def distances(texts: list[str | None], profiles: dict[str, list[int]], top: int = TOP):
    """Out-of-place distance of each text to each language (sorted), and how many n-grams each text was held by."""
    langs = sorted(profiles)
    vocabulary = np.unique(np.array([g for p in profiles.values() for g in p], dtype=np.int64))
    ranks = np.full((len(vocabulary) + 1, len(langs)), -1, dtype=np.int64)
    for j, lang in enumerate(langs):
        ranks[np.searchsorted(vocabulary, np.array(profiles[lang], dtype=np.int64)), j] = np.arange(len(profiles[lang]))
    total, held = np.zeros((len(texts), len(langs))), np.zeros(len(texts), dtype=np.int64)
    step = 2**_DOC - 1
    for lo, hi in utf8_slices(texts, SLICE_CHARS):
        for a in range(lo, hi, step):
            b = min(hi, a + step)
            long = b - a == 1 and texts[a] is not None and len(texts[a]) > SLICE_CHARS
            of, code, rank, _ = ranked_long(texts[a], top) if long else ranked_grams(texts[a:b], top)
            if not len(of):
                continue
            at = np.searchsorted(vocabulary, code)
            at[(at == len(vocabulary)) | (vocabulary[np.minimum(at, len(vocabulary) - 1)] != code)] = len(vocabulary)
            theirs = ranks[at]
            apart = np.where(theirs < 0, top, np.abs(theirs - rank[:, None]))
            for j in range(len(langs)):
                total[a:b, j] += np.bincount(of, weights=apart[:, j], minlength=b - a)
            held[a:b] += np.bincount(of, minlength=b - a)
    return langs, total, held


def predict(
    docs: DataFrame,
    profiles: dict[str, list[int]],
    columns: list[str],
    top: int = TOP,
    names: tuple[str, str] = ("lang_pred", "score"),
) -> DataFrame:
    """The named columns plus the predicted language and its score (1: every n-gram in place, 0: none known)."""
    schema = docs.select(*columns).schema.add(names[0], "string").add(names[1], "double")
    n = len(columns)
    at = columns.index("text") if "text" in columns else n

    def judge(batches):
        for batch in sliced(batches):
            texts = batch.column(at).to_pylist()
            pred, score = ["und"] * len(texts), np.zeros(len(texts))
            if profiles:
                langs, total, held = distances(texts, profiles, top)
                best = total.argmin(axis=1)
                score = np.where(held > 0, 1 - total[np.arange(len(texts)), best] / np.maximum(1, held * top), 0.0).clip(0, 1)
                pred = [langs[j] if h else "und" for j, h in zip(best, held, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n], pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                names=schema.names,
            )

    return docs.select(*columns, *([F.col("text").alias("__text")] if at == n else [])).mapInArrow(judge, schema)


def recognised(docs: DataFrame, min_score: float = 0.1, top: int = TOP, per_lang: int = TRAIN_PER_LANG) -> DataFrame:
    """docs without those whose language isn't recognised: `und`, or a score under min_score."""
    usable = F.col("doc_id").isNotNull() & ~held_out()
    profiles = learn(training_rows(docs.select("doc_id", "lang", "text"), usable, per_lang), top)
    judged = predict(docs, profiles, docs.columns, top, ("__lang", "__score"))
    return judged.where((F.col("__lang") != "und") & (F.col("__score") >= min_score)).select(*docs.columns)


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def language_id(docs: DataFrame, top: int = TOP, per_lang: int = TRAIN_PER_LANG) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the documents that aren't held out."""
    usable = F.col("doc_id").isNotNull() & ~held_out()
    profiles = learn(training_rows(docs.select("doc_id", "lang", "text"), usable, per_lang), top)
    marked = docs.select("doc_id", held_out().alias("held_out"), "text")
    return predict(marked, profiles, ["doc_id", "held_out"], top)
