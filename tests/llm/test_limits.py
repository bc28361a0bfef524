"""Memory, spill, very long texts and many matches; parallel reads; clashing names of our own columns."""

import collections
import random
import re
import sys
import time

import helpers as H
import pytest
from pyspark.sql import functions as F

from mealops.llm import components, exact_dedup, line_dedup, line_quality, secret_scan, simhash, warc


# 3 ------------------------------------------------------------------ exact dedup

def deep_size(trie) -> int:
    total, stack = 0, [trie.root]
    while stack:
        node = stack.pop()
        total += sys.getsizeof(node)
        if node.owner is not None:
            total += sys.getsizeof(node.owner) + sum(map(sys.getsizeof, node.owner))
        if node.edges is not None:
            total += sys.getsizeof(node.edges)
            for label, child in node.edges.values():
                total += sys.getsizeof((label, child)) + sys.getsizeof(label)
                stack.append(child)
    return total


@pytest.mark.parametrize("size,n", [(12, 30_000), (200, 5000), (3000, 500)])
def test_held_is_what_a_trie_takes(size, n):
    rng, trie = random.Random(size), exact_dedup.Trie()
    for i in range(n):
        trie.add(rng.randbytes(size), i, 1)
    assert 0.75 <= trie.held / deep_size(trie) <= 1.6
    assert sum(trie.sizes.values()) == trie.held
    assert sum(1 for _ in trie.drain()) == n and trie.held == 0


def batches(texts):
    import pyarrow as pa
    for a in range(0, len(texts), 1000):
        part = texts[a:a + 1000]
        yield pa.record_batch([pa.array(part, pa.binary()), pa.array(range(a, a + len(part)), pa.int64())], names=["t", "d"])


def test_spilling_stays_in_the_limit_and_is_cheap():
    rng = random.Random(1)
    texts = [rng.randbytes(rng.choice((12, 13, 40, 41))) for _ in range(40_000)]
    texts += texts[:2000]

    def run(limit):
        t, n = time.process_time(), 0
        counts = {}
        for b in exact_dedup._owners(limit, keep_text=True)(batches(texts)):
            n += 1
            for text, k in zip(b.column(2).to_pylist(), b.column(4).to_pylist(), strict=True):
                counts[text] = counts.get(text, 0) + k
        return time.process_time() - t, counts
    free, whole = min((run(1 << 30) for _ in range(3)), key=lambda r: r[0])
    tight, parts = min((run(4 << 20) for _ in range(3)), key=lambda r: r[0])
    assert whole == parts and sum(whole.values()) == len(texts)
    assert tight < 2 * free, (tight, free)


def test_two_texts_of_one_digest_raise(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.hashlib, "sha256", lambda t=b"": type("H", (), {"hexdigest": lambda self: "same"})())
    local = [b for b in exact_dedup._owners(64, keep_text=False)(batches([b"ab", b"cd", b"ab"]))]
    assert len({m for b in local for m in b.column(5).to_pylist()}) == 2          # spilled or not, both marks leave


def test_very_long_texts(spark):
    rows = [(i, "long " * 200_000 + str(i % 2)) for i in range(4)] + [(9, "x")]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.dedup_exact(H.frame(spark, rows), trie_bytes=1 << 20).collect()}
    assert got == {0: (2, 2), 2: (2, 2), 1: (3, 2), 3: (3, 2), 9: (9, 1)}


# 6 ------------------------------------------------------------------ secret scans

def masked(text):
    out, at = "", 0
    for a, _, b in H.secrets(text):
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def test_a_hundred_thousand_matches(spark):
    text = "é".join(f"{i:024x} " for i in range(100_000))
    t = time.time()
    df = secret_scan.scan(H.frame(spark, [(1, text), (2, "no secret")]))
    got = {r[0]: r[1:] for r in df.select("doc_id", F.size("secret_spans"), secret_scan.redacted(df["text"], df["secret_spans"]),
                                          "secret_spans").collect()}
    assert time.time() - t < 60
    assert got[1][0] == 100_000 and got[1][1] == "é".join(["[SECRET] "] * 100_000)
    assert [(s.start, s.stop) for s in got[1][2][:3]] == [(0, 24), (26, 50), (52, 76)]
    assert got[2][:2] == (0, "no secret")


def test_masking_overlaps(spark):
    rng = random.Random(3)
    parts = ("token=", "deadbeef" * 3, "AKIA" + "A" * 16, "é日本", " ", "secret: ", "password=token:abcdefgh", "\n", "api_key=")
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))) for i in range(200)]
    df = secret_scan.scan(H.frame(spark, rows))
    got = dict(df.select("doc_id", secret_scan.redacted(df["text"], df["secret_spans"])).collect())
    assert got == {i: masked(t) for i, t in rows}


def test_seen_texts_do_not_move(spark):
    ledger = secret_scan.new_ledger(spark)
    docs = H.frame(spark, [(i, f"text {i} token=abcdef{i}") for i in range(50)])
    secret_scan.update(docs, ledger)
    more = docs.unionByName(H.frame(spark, [(99, "a new one")]))
    plan = secret_scan.unseen(more, ledger, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    assert [r.body for r in secret_scan.unseen(more, ledger, "doc_id", "text").collect()] == ["a new one"]
    before = spark.read.parquet(ledger).count()
    secret_scan.update(docs, ledger)
    assert spark.read.parquet(ledger).count() == before


def test_a_first_scan_moves_texts_whatever_the_size(spark):
    docs = H.frame(spark, [(i, f"text {i} token=abcdef{i}") for i in range(50)])
    new = secret_scan.unseen(docs, secret_scan.new_ledger(spark), "doc_id", "text")
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert sorted(r.body for r in new.collect()) == sorted(f"text {i} token=abcdef{i}" for i in range(50))


def test_own_names_in_the_input(spark):
    names = ("__spans", "__blob", "__body", "__id", "__rep", "row", "own", "body", "blob", "id", "spans", "todo", "s", "reach")
    df = H.frame(spark, [(1, "token=abcdef1"), (2, None)])
    for n in names:
        df = df.withColumn(n, F.lit(n))
    got = secret_scan.scan(df)
    assert got.columns == [*[c for c in df.columns if c != "secret_spans"], "secret_spans", "blob_sha256"]
    assert [(r.doc_id, len(r.secret_spans), r["__spans"]) for r in got.orderBy("doc_id").collect()] == [
        (1, 1, "__spans"), (2, 0, "__spans")]


# 8 ------------------------------------------------------------------ WARC

def test_reads_follow_the_bytes(spark):
    df = spark.createDataFrame([(i, f"http://h{i}.org/", f"page {i} " * 400) for i in range(300)],
                               "page_id long, url string, html string")
    arch = warc.archive(df)
    assert arch.n_records == 300 and arch.n_bytes > 20_000
    found = warc.lookup(spark, arch, df)
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    per_task = found.groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) > 1 and sum(r["count"] for r in per_task) == 300
    tight = warc.lookup(spark, arch, df, per_task=arch.n_bytes // 40)
    assert tight.rdd.getNumPartitions() >= 40 and tight.count() == 300


def test_very_long_pages(spark):
    df = spark.createDataFrame([(1, "http://a.org/", "<p>" * 3_000_000), (2, "http://b.org/", "<p>" * 3_000_000), (3, None, None)],
                               "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.lookup(spark, warc.archive(df), df).collect()}
    assert got == {1: (9_000_000, "response", None), 2: (9_000_000, "revisit", 1), 3: (0, "response", None)}


# 10 ----------------------------------------------------------------- line dedup

def test_filter_beyond_its_bound(spark):
    """More lines than the broadcast filter is for: the maps stay distributed, and the result is the same."""
    rng = random.Random(7)
    texts = ["\n".join(f"line number {rng.randint(0, 60_000)}" if rng.random() < .5 else "the most frequent line" if k % 9 else "tiny"
                       for k in range(500)) for _ in range(100)]
    rows = list(enumerate(texts)) + [(None, texts[0]), (3, "the most frequent line"), (200, None)]
    docs = H.frame(spark, rows).repartition(6)
    small = 64 * line_dedup._WORDS_PER_SEGMENT
    assert 12 * line_dedup.count_lines(docs.select("text")) > small
    bodies = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("mark"), F.col("text").alias("body"))
    few = line_dedup._suspects(bodies, small, 10).count()
    assert few < 0.75 * sum(len(t.split("\n")) for t in texts)                       # the filter does filter
    got = collections.Counter((r.doc_id, r.text) for r in line_dedup.dedup_lines(docs, filter_bits=small).collect())
    assert got == collections.Counter((i, t) for (i, _), t in zip(rows, H.line_kept(rows), strict=True))
    assert got == collections.Counter((r.doc_id, r.text) for r in line_dedup.dedup_lines(docs).collect())


def test_no_line_of_two_documents_is_lost():
    """Per segment: a hash that two lots hold, or one lot holds twice, always passes."""
    import numpy as np
    import pyarrow as pa
    rng = np.random.default_rng(2)
    own = [rng.integers(0, 2 ** 64, 40_000, np.uint64) for _ in range(3)]
    shared = rng.integers(0, 2 ** 64, 500, np.uint64)
    lots = [(x.tobytes(), b"") for x in own] + [(shared[:300].tobytes(), b""), (shared[:300].tobytes(), shared[300:].tobytes())]
    batch = pa.record_batch([pa.array([0] * len(lots), pa.int32()), pa.array([a for a, _ in lots], pa.binary()),
                             pa.array([b for _, b in lots], pa.binary())], names=["segment", "once", "twice"])
    out = np.concatenate([b.column(0).to_numpy() for b in line_dedup._segment_suspects(1)(iter([batch]))]).view(np.uint64)
    assert set(shared.tolist()) <= set(out.tolist())


# 1 ------------------------------------------------------------------ components, SimHash

def test_a_star_with_a_hub(spark):
    edges = spark.range(1, 20_001).selectExpr("0L as a", "id as b").unionByName(
        spark.range(20_001, 20_101).selectExpr("id as a", "id + 100 as b"))
    got = components.components(edges).groupBy("root").count().orderBy(F.col("count").desc())
    assert got.first()[:2] == (0, 20_001) and got.count() == 101


def test_buckets_are_dealt_to_tasks_of_their_number(spark):
    fps = spark.range(9000).select(F.xxhash64("id").alias("fp")).distinct()
    plan = simhash.near_links(fps, per_bucket=500)._jdf.queryExecution().logical().toString()
    buckets = -(-fps.count() // 500)
    assert re.search(rf"RepartitionByExpression \[bucket#\d+\], {2 * buckets}\b", plan), plan


# 4 ------------------------------------------------------------------ quality rules

def test_long_sequences_are_cut_for_the_fit(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(line_quality, "fit_field", lambda s: seen.extend(len(y) for _, y in s))
    docs = H.frame(spark, [(1, "words of a text\n" * 900), (2, "#### $$$$ !!!!\n" * 500)])
    line_quality.fit(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality long"))
    assert max(seen) == 200 and sum(seen) == 1400


def test_decide_and_keep_take_own_names(spark):
    df = H.frame(spark, [(1, "word " * 30), (2, "some different words make up this text of more than ten of them")])
    assert "__quality" in df.columns
    assert line_quality.keep(df, None).columns == df.columns
    assert line_quality.decide(df, None).select("__quality.kept").count() == 2
