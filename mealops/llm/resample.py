"""Target-distribution importance resampling with batch concatenation (operator 13).

*Words*: A-Z lowered; runs of a-z, 0-9 and everything beyond ASCII.
*Features*: all runs of 1 to ``max_run`` consecutive words joined by one
space, repeats counted, hashed to ``buckets`` buckets by CRC-32.

1. *Batch concatenation.* The texts of a batch are joined with a separator
   that no word holds, one regex pass over the whole buffer finds all words,
   and ``searchsorted`` over the texts' offsets tells each word's text. A run
   whose first and last word lie in different texts is masked out before the
   buckets are counted. A document's buckets leave the task as two bytes a
   feature, so texts are read once, whole, and never shuffled.
2. Every task sums its features by bucket; an aggregate adds the tasks up.
   Only the ``buckets`` gains (at most 65,536 numbers) reach the driver, and
   they are all that is broadcast.
3. A document's weight is the floored mean of its features' gains; a Gumbel
   draw from a hash of (seed, id) is added, and the highest scores are drawn
   without replacement.
4. Ranks come from a range partitioning by (drawable, score, id) with
   per-partition counts: no global window, no row passes the driver.

Defined cases: null or empty text -> no word, weight 0; a null id hashes as
the empty text and ranks after all others on ties; repeated rows are scored
alike and ranked one after the other; empty table -> empty result; an empty
target gives every bucket its smoothed gain; other columns are not carried.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_named, text_of, written

#: Fixed by the contract: runs of letters, digits and bytes beyond ASCII, as UTF-8.
WORD = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SEPARATOR = b"\n"
_IS_WORD = np.array([re.fullmatch(WORD, bytes([b])) is not None for b in range(256)])
_BUFFER = 4 << 20
_KNOWN = 500_000


class _Buckets(dict):
    """word -> CRC-32 of its bytes, remembered (for single words)."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KNOWN:
            self.clear()
        h = self[word] = zlib.crc32(word)
        return h


class Featurizer:
    """Texts to features, a buffer of joined texts at a time."""

    def __init__(self, max_run: int, buckets: int):
        self.max_run, self.buckets, self.known, self.word = max_run, buckets, _Buckets(), re.compile(WORD)

    def __call__(self, texts: list[bytes]) -> list[tuple[int, np.ndarray]]:
        """(number of words, bucket of every feature) of each text."""
        joined = _SEPARATOR.join(texts).lower()
        offsets = np.cumsum([0] + [len(t) + len(_SEPARATOR) for t in texts])
        words = self.word.findall(joined)
        inside = _IS_WORD[np.frombuffer(joined, np.uint8)]
        starts = np.flatnonzero(inside & ~np.r_[False, inside[:-1]]) if len(inside) else np.zeros(0, np.int64)
        owner = np.searchsorted(offsets, starts, side="right") - 1
        n_words = np.bincount(owner, minlength=len(texts))[:len(texts)]
        owners, found = [], []
        crc = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        for run in range(1, self.max_run + 1):
            if run > 1:                    # each run is the run before, extended by one word
                crc = np.fromiter((zlib.crc32(b" " + w, int(c)) for c, w in zip(crc, words[run - 1:], strict=False)),
                                  np.int64, max(0, len(words) - run + 1))
            last = owner[run - 1:]
            same = owner[:len(last)] == last
            owners.append(last[same])
            found.append((crc[:len(last)][same] % self.buckets).astype("<u2"))
        owners, found = np.concatenate(owners), np.concatenate(found)
        if self.max_run > 1:
            order = np.argsort(owners, kind="stable")
            owners, found = owners[order], found[order]
        cuts = np.searchsorted(owners, np.arange(len(texts) + 1))
        return [(int(n_words[i]), found[cuts[i]:cuts[i + 1]]) for i in range(len(texts))]


def _features(max_run: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        featurize = Featurizer(max_run, buckets)

        def out(docs: list, texts: list[bytes]) -> pa.RecordBatch:
            rows = featurize(texts)
            return pa.record_batch([pa.array(docs, pa.int64()), pa.array([n for n, _ in rows], pa.int64()),
                                    pa.array([b.tobytes() for _, b in rows], pa.binary())],
                                   names=["doc", "n_words", "features"])

        for batch in batches:
            docs, texts, held = [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs.append(doc)
                texts.append((text.as_py() or "").encode("utf-8", "replace"))
                held += len(texts[-1])
                if held >= _BUFFER:
                    yield out(docs, texts)
                    docs, texts, held = [], [], 0
            if docs:
                yield out(docs, texts)

    return run


def features(docs: DataFrame, text: str, doc_id: str | None, max_run: int, buckets: int) -> DataFrame:
    """(doc, n_words, features): ``features`` holds two bytes per feature, its bucket."""
    d = rows_named(docs, *([doc_id] if doc_id else []), text)
    key = F.col(doc_id).cast("long") if doc_id else F.lit(None).cast("long")
    return d.select(key, text_of(d, text)).mapInArrow(_features(max_run, buckets),
                                                      "doc long, n_words long, features binary")


def bucket_counts(found: DataFrame, buckets: int) -> np.ndarray:
    """Features by bucket over all rows: summed within tasks, then by an aggregate."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for f in batch.column(0):
                total += np.bincount(np.frombuffer(f.as_buffer(), "<u2"), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    summed = found.select("features").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for r in summed.collect():                                   # one row a bucket
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log of the smoothed ratio of the two bucket distributions), by bucket."""
    b, s, t = len(corpus), corpus.astype(float), target.astype(float)
    ratio = (t + 1.0) * (s.sum() + b) / ((s + 1.0) * (t.sum() + b))
    return np.floor(1000.0 * np.log(ratio)).astype(np.int64)


def _weights(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = np.frombuffer(shared.value, np.int64)
        for batch in batches:
            n, w = [], []
            for f in batch.column(2):
                own = np.frombuffer(f.as_buffer(), "<u2")
                n.append(len(own))
                w.append(int(gain[own].sum()) // len(own) if len(own) else 0)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(w, pa.int64())],
                                  names=["doc", "n_words", "n_features", "weight"])
    return run


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text",
             target_text: str = "text", max_run: int = 1, buckets: int = 10_000, seed: str = "2024",
             min_words: int = 20, percent: int = 10) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) per row: ``rank`` counts the drawn rows from 1, others are null.

    ``floor(percent * N / 100)`` of the N rows with at least ``min_words`` words are drawn.
    """
    if not 1 <= buckets <= 65_536:
        raise ValueError("buckets must be 1 to 65536")
    spark = docs.sparkSession
    found = written(features(docs, text, doc_id, max_run, buckets), "resample-features")
    gain = gains(bucket_counts(found, buckets),
                 bucket_counts(features(target, target_text, None, max_run, buckets), buckets))
    shared = spark.sparkContext.broadcast(gain.tobytes())
    weighed = found.mapInArrow(_weights(shared), "doc long, n_words long, n_features long, weight long")
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc").cast("string"), F.lit(""))),
                                     256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((draw + 0.5) / F.lit(4294967296.0))))
    scored = written(weighed.select("doc", "n_features", "weight", (F.col("weight") + gumbel).cast("long").alias("score"),
                                    (F.col("n_words") >= min_words).alias("drawable")), "resample-scores")
    # Ties of score and id are told apart by the row's place in the written table, so no key is hot.
    order = [F.col("drawable").desc(), F.col("score").desc(), F.col("doc").asc_nulls_last(), F.col("place").asc()]
    placed = scored.withColumn("place", F.monotonically_increasing_id())
    ranged = written(placed.repartitionByRange(*order).sortWithinPartitions(*order)
                     .withColumn("at", F.monotonically_increasing_id()).drop("place"), "resample-order")
    part, within = F.shiftrightunsigned("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted(ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # one row a partition
    total = int(ranged.where("drawable").count()) * percent // 100
    before, offsets = 0, []
    for r in sizes:
        offsets.append((r.part, before))
        before += r.n
    if offsets:
        start = spark.createDataFrame(offsets, "part long, before long")
        ranged = ranged.join(F.broadcast(start), part == start["part"])
        place = F.col("before") + within + 1
    else:
        place = within + 1
    rank = F.when(F.col("drawable") & (place <= total), place)
    return ranged.select(F.col("doc").alias(doc_id), "n_features", "weight", "score", rank.cast("long").alias("rank"))
