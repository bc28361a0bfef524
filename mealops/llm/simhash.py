"""SimHash near-dedup by meet-in-the-middle ball hashing (operator 1).

*Fingerprint*: 64 majority bits over the XXH64 hashes of a text's word
shingles. *Links*: fingerprints that differ in at most ``radius`` bits
(0 to 3).

Two fingerprints at distance d <= 3 meet at a common variant when one flips
floor(d/2) of the differing bits and the other the rest, so both need only
flip up to half the radius:

* distance 1, 2: every fingerprint emits itself and its 64 one-bit variants;
* distance 3 (odd): one end has an even and the other an odd number of set
  bits. Only the even end flips two bits, and only two bits of the same
  32-bit half: of three differing bits, two always share a half. That is
  992 of the 2016 pairs.

Variants are shuffled, not fingerprints pairs. At one variant, let *near* be
the ends with at most one flip and *far* those with two. Ends in *near* are
within 2 bits of each other and within 3 bits of every *far* end; two *far*
ends have equal parity and meet elsewhere if they are within 2. So one star
from the smallest *near* end holds every link that the variant can prove:
a variant with m ends gives m - 1 links, never all pairs. Every link's
distance is verified, repeats are dropped, and connected components (see
``components``) give the groups.

Equal fingerprints are one node: copies do not multiply any of this.

Variants travel in blocks: a task computes the variants of a block of
fingerprints with numpy and sends, per bucket of the variants' hash, the
fingerprints, how many variants each has there, and the flips' numbers.

Defined cases: null or empty text, or no word -> fingerprint 0, linked like
any other; fewer words than a shingle -> the whole word sequence is the only
shingle; null ids are carried and never a component's id unless nothing else
is there (then null); repeated rows share their fingerprint; empty table ->
empty result; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_named, text_of, written
from .components import components

_BLOCK = 8192


def shingles(text: str | None, size: int) -> list[bytes]:
    """Space-joined shingles of ``size`` lower-cased words; repeats included."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return []
    if len(words) < size:
        return [b" ".join(words)]
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-size])) if size else ends
    return [joined[a:b] for a, b in zip(starts.tolist(), (ends[size - 1:] - 1).tolist(), strict=True)]


def fingerprint(text: str | None, size: int = 3) -> int:
    """Unsigned 64-bit SimHash: a bit is set if it is set in over half of the shingle hashes."""
    grams = shingles(text, size)
    if not grams:
        return 0
    ones = np.zeros(64, np.int64)
    for low in range(0, len(grams), 1 << 16):
        part = grams[low:low + (1 << 16)]
        h = np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in part), "<u8", len(part))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(grams), bitorder="little").view("<u8")[0])


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), size) for t in batch.column(2)], np.uint64)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))],
                                  names=["doc", "mark", "fp"])
    return run


def flips(radius: int) -> tuple[np.ndarray, int]:
    """Masks to flip, by number of bits, and how many of them have at most one bit."""
    bit = [np.uint64(1) << np.uint64(i) for i in range(64)]
    none, one = [np.uint64(0)], bit if radius >= 1 else []
    two = [bit[i] | bit[j] for half in (0, 32) for i in range(half, half + 32) for j in range(i + 1, half + 32)] \
        if radius >= 3 else []
    return np.array([*none, *one, *two], np.uint64), len(none) + len(one)


def _scatter(v: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each variant (a multiplicative hash, high bits)."""
    return (((v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _variants(radius: int, buckets: int):
    """Batches of different fingerprints -> (bucket, fingerprints, variants of each, flips) blocks."""
    schema = pa.schema([("bucket", pa.int32()), ("fps", pa.binary()), ("runs", pa.binary()), ("flip", pa.binary())])

    def block(fps: np.ndarray) -> pa.RecordBatch:
        masks, short = flips(radius)
        even = (np.bitwise_count(fps) & 1) == 0
        at, flip = [], []
        for rows, count in ((np.flatnonzero(~even), short), (np.flatnonzero(even), len(masks))):
            at.append(np.repeat(rows, count))
            flip.append(np.tile(np.arange(count, dtype="<u2"), len(rows)))
        at, flip = np.concatenate(at), np.concatenate(flip)
        place = _scatter(fps[at] ^ masks[flip], buckets) * _BLOCK + at     # by bucket, then by fingerprint
        order = np.argsort(place, kind="stable")
        place, flip = place[order], flip[order]
        heads = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])       # one per (bucket, fingerprint)
        runs = np.diff(np.r_[heads, len(place)]).astype("<u2")
        bucket, own = place[heads] // _BLOCK, fps[place[heads] % _BLOCK]
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
        cols: list[list] = [[], [], [], []]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            last = heads[b] if b < len(heads) else len(place)
            for col, x in zip(cols, (int(bucket[a]), own[a:b].tobytes(), runs[a:b].tobytes(),
                                     flip[heads[a]:last].tobytes()), strict=True):
                col.append(x)
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.asarray(batch.column(0)).view(np.uint64)
            for low in range(0, len(fps), _BLOCK):
                yield block(fps[low:low + _BLOCK])

    return run, "bucket int, fps binary, runs binary, flip binary"


def _stars(radius: int):
    """All blocks of a task's buckets -> verified star links, without repeats."""

    def links(parts: list[tuple[np.ndarray, np.ndarray]], short: int, masks: np.ndarray) -> np.ndarray:
        fp, flip = (np.concatenate(x) for x in zip(*parts, strict=True))
        variant = fp ^ masks[flip]
        order = np.lexsort((fp, flip >= short, variant))      # near ends first, the smallest in front
        fp, far, variant = fp[order], (flip >= short)[order], variant[order]
        first = np.r_[True, variant[1:] != variant[:-1]]
        head = np.flatnonzero(first)[np.cumsum(first) - 1]
        keep = ~first & ~far[head]
        a, b = fp[head[keep]], fp[keep]
        ok = (a != b) & (np.bitwise_count(a ^ b) <= radius)
        return np.unique(np.stack([np.minimum(a[ok], b[ok]), np.maximum(a[ok], b[ok])], axis=1), axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks, short = flips(radius)
        held: dict[int, list] = {}
        bucket = None

        def out() -> pa.RecordBatch:
            pairs = links(held.pop(bucket), short, masks).view(np.int64)
            return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            for b, fps, runs, flip in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket is not None and b != bucket:
                    yield out()
                bucket = b
                own = np.repeat(np.frombuffer(fps, np.uint64), np.frombuffer(runs, "<u2"))
                held.setdefault(b, []).append((own, np.frombuffer(flip, "<u2")))
        if bucket is not None:
            yield out()

    return run


def near_links(fps: DataFrame, radius: int = 3, per_bucket: int = 4096) -> DataFrame:
    """``fps``: one long column of different fingerprints. Links (a, b) that span each group of fingerprints
    within ``radius`` bits; buckets hold the variants of about ``per_bucket`` fingerprints."""
    if not 0 <= radius <= 3:
        raise ValueError("radius must be 0 to 3")
    n = fps.count()
    buckets = max(1, -(-n // per_bucket))
    run, schema = _variants(radius, buckets)
    blocks = fps.repartition(max(1, -(-n // _BLOCK)), fps.columns[0]).mapInArrow(run, schema)
    # Twice as many tasks as buckets, so that a task holds few of them however many there are.
    tasks = max(2 * buckets, fps.sparkSession.sparkContext.defaultParallelism)
    return (blocks.repartition(tasks, "bucket").sortWithinPartitions("bucket")
            .mapInArrow(_stars(radius), "a long, b long").distinct())


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3,
                radius: int = 3) -> DataFrame:
    """(doc, mark, fp, root, component_id) per row: ``mark`` is a hash of the text, ``root`` the smallest
    fingerprint of the group, ``component_id`` its smallest document id."""
    d = rows_named(docs, doc_id, text)
    body = text_of(d, text)
    marked = written(d.select(F.col(doc_id).cast("long"), F.xxhash64(body), body)
                     .mapInArrow(_fingerprints(shingle), "doc long, mark long, fp long"), "simhash")
    nodes = written(marked.groupBy("fp").agg(F.min("doc").alias("low")), "simhash-nodes")
    roots = components(near_links(nodes.select("fp"), radius))
    grouped = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("low").alias("component_id"))
    # A table of its own, so that the join can split a fingerprint that very many rows share.
    of_fp = written(grouped.join(least, "root").select("fp", "root", "component_id"), "simhash-groups")
    return marked.join(of_fp, "fp")


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3,
               radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id): component_id is the smallest id reachable over links."""
    return near_groups(docs, doc_id, text, shingle, radius).select(
        F.col("doc").alias(doc_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3,
              radius: int = 3) -> DataFrame:
    """One row of each group of ``docs``: that of the smallest id (null last; of its texts, the least hash)."""
    groups = near_groups(docs, doc_id, text, shingle, radius)
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc").isNull(), F.col("doc"), F.col("mark"))).alias("f"))
    # Struct equality takes nulls as equal; join and de-duplication share one exchange of the texts.
    first = first.select(F.struct(F.col("f.doc").alias("doc"), F.col("f.mark").alias("mark")).alias("__keep"))
    mark = F.xxhash64(F.coalesce(docs[text].cast("string"), F.lit("")))
    d = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"),
                    F.struct(docs[doc_id].cast("long").alias("doc"), mark.alias("mark")).alias("own"))
    return (d.join(first, F.col("own") == F.col("__keep")).dropDuplicates(["__keep"])
            .select(*[F.col("row")[c].alias(c) for c in docs.columns]))
