"""Line dedup with two Bloom filters (operator 10).

1. Every task hashes the keys of its lines (64 bits), once per document, and
   sets each key's bits in one 64-bit word: in a *once* map, and in a *twice*
   map where the task saw the key in two documents. The touched words leave
   the task by segment; no line leaves it.
2. A streaming fold per segment merges the maps: a bit set by two tasks
   becomes a twice bit (``twice |= once & new``). A key held by two documents
   always ends with all its bits in *twice*; other keys do so rarely.
3. Up to ``filter_bits / 12`` lines (newlines are counted first) the twice map
   has the fixed size of ``filter_bits`` (16 MiB by default), so it may be
   broadcast, and every task tests its own lines.
   Beyond that the maps stay distributed: the hashes themselves are shuffled
   by segment, as many segments as the lines need, a task folds a segment's
   two maps and tests the segment's hashes against them, and the hashes that
   pass are joined to the lines (broadcast if they are few). Either way a
   key that passes by mistake only means a suspect more, never another result.
4. Only lines whose key passes the twice map are shuffled, with their whole
   key: an aggregate (combined before the shuffle) confirms the key in two
   documents and finds the smallest; the lines of other documents go.

A line's key is the line stripped of ASCII white space with A-Z lowered; keys
shorter than ``min_key`` code points are left alone.

Defined cases: null or empty text -> one empty line; a null document id
counts as one document, before all others; rows that repeat a document id are
one document for the count; repeated lines within one document stay in the
first document; empty table -> empty result; other columns are carried
(columns named ``n_lines`` or ``n_dropped`` are replaced).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, broadcast_small, written

_WORDS_PER_SEGMENT = 8192
_FLUSH = 1 << 20


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE.encode()).lower()


def long_enough(key: bytes, min_key: int) -> bool:
    n = len(key)
    return n >= min_key and (n >= 4 * min_key or len(key.decode("utf-8", "replace")) >= min_key)


def _keys(text: str | None, min_key: int) -> list[bytes]:
    return [k for k in map(line_key, (text or "").encode("utf-8", "replace").split(b"\n")) if long_enough(k, min_key)]


def _hashes(keys) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def _word_and_mask(h: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of each hash and its four bits within that word."""
    one, mask = np.uint64(1), np.zeros(len(h), np.uint64)
    for shift in (40, 46, 52, 58):
        mask |= one << ((h >> np.uint64(shift)) & np.uint64(63))
    return (h % np.uint64(words)).astype(np.int64), mask


def _or_by_word(word: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(word, kind="stable")
    word, mask = word[order], mask[order]
    starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    return word[starts], np.bitwise_or.reduceat(mask, starts)


def _maps(words: int, min_key: int):
    """Batches of texts -> touched words of the once and twice maps by segment."""
    schema = pa.schema([("segment", pa.int32()), ("at", pa.binary()), ("once", pa.binary()), ("twice", pa.binary())])

    def fold(parts: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(parts), return_counts=True)
        w, m = _word_and_mask(h, words)
        at, once = _or_by_word(w, m)
        twice = np.zeros(len(at), np.uint64)
        if (n > 1).any():
            at2, t = _or_by_word(w[n > 1], m[n > 1])
            twice[np.searchsorted(at, at2)] = t
        seg = at // _WORDS_PER_SEGMENT
        cuts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1], True])
        inside = (at % _WORDS_PER_SEGMENT).astype("<u2")
        spans = list(zip(cuts[:-1], cuts[1:], strict=True))
        return pa.record_batch([
            pa.array(seg[cuts[:-1]], pa.int32()), pa.array([inside[a:b].tobytes() for a, b in spans], pa.binary()),
            pa.array([once[a:b].tobytes() for a, b in spans], pa.binary()),
            pa.array([twice[a:b].tobytes() for a, b in spans], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for text in batch.column(0):
                keys = set(_keys(text.as_py(), min_key))
                if keys:
                    parts.append(_hashes(keys))
                    held += len(keys)
                if held >= _FLUSH:
                    yield fold(parts)
                    parts, held = [], 0
        if parts:
            yield fold(parts)

    return run, "segment int, at binary, once binary, twice binary"


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold the rows of each segment into its twice map (two maps per segment of this task are held)."""
    maps: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for seg, at, once, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if seg not in maps:
                maps[seg] = (np.zeros(_WORDS_PER_SEGMENT, np.uint64), np.zeros(_WORDS_PER_SEGMENT, np.uint64))
            all_once, all_twice = maps[seg]
            i, new = np.frombuffer(at, "<u2"), np.frombuffer(once, np.uint64)
            all_twice[i] |= np.frombuffer(twice, np.uint64) | (all_once[i] & new)
            all_once[i] |= new
    for seg, (_, t) in maps.items():
        yield pa.record_batch([pa.array([seg], pa.int32()), pa.array([t.tobytes()], pa.binary())],
                              names=["segment", "twice"])


def twice_map(texts: DataFrame, filter_bits: int, min_key: int) -> np.ndarray:
    """The twice map over the one text column of ``texts``: ``filter_bits / 64`` words."""
    words = filter_bits // 64
    run, schema = _maps(words, min_key)
    merged = (texts.mapInArrow(run, schema).repartition("segment")
              .mapInArrow(_merged, "segment int, twice binary"))
    out = np.zeros(words, np.uint64)
    for r in merged.collect():             # filter_bits / 8 bytes at most, whatever the input
        out[r.segment * _WORDS_PER_SEGMENT:(r.segment + 1) * _WORDS_PER_SEGMENT] = np.frombuffer(r.twice, np.uint64)
    return out


def _hash_lots(segments: int, min_key: int):
    """Batches of texts -> (segment, hashes seen in one document, hashes seen in two) per lot of lines."""
    schema = pa.schema([("segment", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])

    def fold(parts: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(parts), return_counts=True)
        seg = (h % np.uint64(segments)).astype(np.int64)
        order = np.argsort(seg, kind="stable")
        h, n, seg = h[order], n[order], seg[order]
        cuts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1], True])
        cols: list[list] = [[], [], []]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own, many = h[a:b], n[a:b] > 1
            for col, x in zip(cols, (int(seg[a]), own[~many].tobytes(), own[many].tobytes()), strict=True):
                col.append(x)
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for text in batch.column(0):
                keys = set(_keys(text.as_py(), min_key))
                if keys:
                    parts.append(_hashes(keys))
                    held += len(keys)
                if held >= _FLUSH:
                    yield fold(parts)
                    parts, held = [], 0
        if parts:
            yield fold(parts)

    return run, "segment int, once binary, twice binary"


def _segment_suspects(segments: int):
    """Lots sorted by segment -> the hashes that pass the segment's twice map. One segment is held at a time."""

    def passed(lots: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        once, twice, hashes = np.zeros(_WORDS_PER_SEGMENT, np.uint64), np.zeros(_WORDS_PER_SEGMENT, np.uint64), []
        for single, many in lots:
            for raw, both in ((single, False), (many, True)):
                h = np.frombuffer(raw, np.uint64)
                if not len(h):
                    continue
                hashes.append(h)
                at, bits = _or_by_word(*_word_and_mask(h // np.uint64(segments), _WORDS_PER_SEGMENT))
                twice[at] |= bits if both else once[at] & bits
                once[at] |= bits
        h = np.unique(np.concatenate(hashes))
        w, m = _word_and_mask(h // np.uint64(segments), _WORDS_PER_SEGMENT)
        return pa.record_batch([pa.array(h[(twice[w] & m) == m].view(np.int64))], names=["hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, lots = None, []
        for batch in batches:
            for seg, once, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if seg != at and lots:
                    yield passed(lots)
                    lots = []
                at = seg
                lots.append((once, twice))
        if lots:
            yield passed(lots)

    return run


def suspect_hashes(texts: DataFrame, n_lines: int, min_key: int) -> DataFrame:
    """(hash): the hashes of line keys that may be in two documents, from maps that stay distributed."""
    cores = texts.sparkSession.sparkContext.defaultParallelism
    segments = max(1, -(-12 * n_lines // (64 * _WORDS_PER_SEGMENT)))
    run, schema = _hash_lots(segments, min_key)
    return (texts.mapInArrow(run, schema).repartition(max(cores, -(-segments // 16)), "segment")
            .sortWithinPartitions("segment").mapInArrow(_segment_suspects(segments), "hash long"))


def count_lines(texts: DataFrame) -> int:
    body = F.col(texts.columns[0])
    return texts.agg(F.coalesce(F.sum(F.octet_length(body) - F.octet_length(F.replace(body, F.lit("\n"), F.lit(""))) + 1),
                                F.lit(0))).first()[0]


_LINE = "doc long, mark long, at int, key binary"


def _line_rows(min_key: int, tested):
    """(doc, mark, body) batches -> (doc, mark, at, key, hash) of the lines that ``tested`` (of hashes) lets pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = tested()
        for batch in batches:
            ids, marks, at, keys, hashes = [], [], [], [], []
            for doc, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                       batch.column(2), strict=True):
                lines = (text.as_py() or "").encode("utf-8", "replace").split(b"\n")
                own = [(i, k) for i, k in enumerate(map(line_key, lines)) if long_enough(k, min_key)]
                if not own:
                    continue
                h = _hashes([k for _, k in own])
                for j in np.flatnonzero(test(h)):
                    ids.append(doc)
                    marks.append(mark)
                    at.append(own[j][0])
                    keys.append(own[j][1])
                    hashes.append(h[j])
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(at, pa.int32()),
                                   pa.array(keys, pa.binary()), pa.array(np.array(hashes, np.uint64).view(np.int64))],
                                  names=["doc", "mark", "at", "key", "hash"])
    return run


def _passing(shared, words: int):
    """A test of hashes against the broadcast twice map."""
    def tested():
        twice = np.frombuffer(shared.value, np.uint64)

        def test(h: np.ndarray) -> np.ndarray:
            w, m = _word_and_mask(h, words)
            return (twice[w] & m) == m
        return test
    return tested


def _suspects(bodies: DataFrame, filter_bits: int, min_key: int) -> DataFrame:
    """``bodies`` (doc, mark, body) -> (doc, mark, at, key) of all lines whose key may be in two documents."""
    spark, words = bodies.sparkSession, filter_bits // 64
    texts = bodies.select("body")
    n_lines = count_lines(texts)
    if 12 * n_lines <= filter_bits:
        shared = spark.sparkContext.broadcast(twice_map(texts, filter_bits, min_key).tobytes())
        return bodies.mapInArrow(_line_rows(min_key, _passing(shared, words)), _LINE + ", hash long").drop("hash")
    # Tables of their own, so that the join can split a line that very many documents share.
    hashes = broadcast_small(written(suspect_hashes(texts, n_lines, min_key), "line-hashes"))
    every = bodies.mapInArrow(_line_rows(min_key, lambda: lambda h: np.ones(len(h), bool)), _LINE + ", hash long")
    return every.join(hashes, "hash").drop("hash")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_key: int = 10,
                filter_bits: int = 1 << 27) -> DataFrame:
    """``docs`` with ``text`` cut to its kept lines, and ``n_lines``, ``n_dropped`` (long) added."""
    if filter_bits // 64 % _WORDS_PER_SEGMENT:
        raise ValueError(f"filter_bits must be a multiple of {64 * _WORDS_PER_SEGMENT}")
    # All columns travel as one struct, so that no name can clash with ours.
    d = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    body = F.coalesce(F.col("row")[text].cast("string"), F.lit(""))
    # The mark tells rows apart that repeat a document id.
    named = (F.col("row")[doc_id].cast("long").alias("doc"), F.xxhash64(body).alias("mark"))
    lines = written(_suspects(d.select(*named, body.alias("body")), filter_bits, min_key), "line-suspects")
    order = F.struct(F.col("doc").isNotNull(), F.col("doc"))           # null before all others
    # A table of its own, so that the join can split a line that very many documents share.
    first = written(lines.groupBy("key").agg(F.min(order).alias("low"), F.max(order).alias("high"))
             .where("low != high").select("key", F.col("low.doc").alias("keeper")), "line-keepers")
    gone = (lines.join(first, "key").where(~F.col("doc").eqNullSafe(F.col("keeper")))
            .groupBy("doc", "mark").agg(F.collect_set("at").alias("gone"))
            .select(F.col("doc").alias("of"), F.col("mark").alias("of_mark"), "gone"))
    # The text moves once, within the row; its body is made again behind the join.
    joined = (d.select("row", *named)
              .join(gone, F.col("doc").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("of_mark")), "left")
              .withColumn("body", body).withColumn("parts", F.split(F.col("body"), "\n", -1)))
    stay = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("body")).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get(F.col("parts"), i)), "\n"))
    carried = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return joined.select(*[kept.alias(c) if c == text else F.col("row")[c].alias(c) for c in carried],
                         F.size("parts").cast("long").alias("n_lines"),
                         F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long").alias("n_dropped"))
