"""Registered queries: DuckDB oracles, brute-force versions and the pipeline, on the sf0.001 tables."""

import base64
import collections
import os
import sys
import zlib

import duckdb
import helpers as H
import public_tokenizers
import pytest
import tiktoken
import xxhash

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

import __spark_entry__ as E  # noqa: E402
import corpus_pipeline  # noqa: E402
from check_oracle import TABLES, duck_type, rows_of, spark_type  # noqa: E402

from mealops.llm import line_quality, pii, queries, sharding  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]


def test_one_query_per_operator():
    names = [n for n in E.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in E.queries() and "pipeline" not in E.oracle_sql()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "secret_scans",
                                                            "packing"]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SMALL)
    s_rows = [tuple(r) for r in df.collect()]
    rel = duck.sql(E.oracle_sql()[name])
    d_cols, d_types, d_rows = rel.columns, [duck_type(t) for t in rel.types], rel.fetchall()
    assert sorted(df.columns) == sorted(d_cols)
    assert dict(zip(df.columns, [spark_type(f.dataType) for f in df.schema.fields])) == dict(zip(d_cols, d_types))
    assert rows_of(df.columns, s_rows) == rows_of(d_cols, d_rows)


def table(df, *cols):
    return collections.Counter(tuple(r[c] for c in cols) for r in df.collect())


def test_op1_brute_force(spark, documents):
    fps = {i: H.simhash(t, xxhash) for i, t in documents}
    root = H.groups(list(fps.values()), 3)
    low = {}
    for i, f in sorted(fps.items(), reverse=True):
        low[root[f]] = i
    assert table(E.queries()["op1_simhash_near_dedup"](spark, SMALL), "doc_id", "fingerprint", "component_id") == \
        collections.Counter((i, f"{f:016x}", low[root[f]]) for i, f in fps.items())


def test_op2_brute_force(spark, documents):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in documents}
    pieces = E.queries()["op2_packing"](spark, SMALL).collect()
    seqs, at = collections.defaultdict(list), collections.Counter()
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        own = ids[p.doc_id][p.start:p.start + p.length]
        assert (p.start, p.doc_tokens, len(own)) == (at[p.doc_id], len(ids[p.doc_id]), p.length) and p.length > 0
        assert p.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own))
        at[p.doc_id] += p.length
        seqs[p.sequence_id].append((p.offset, p.length))
    assert at == {i: len(x) for i, x in ids.items()}
    for parts in seqs.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(seqs) * 2048 < 1.1 * sum(at.values()) + 2048 * 8


def test_op7_brute_force(spark, documents):
    rows = E.queries()["op7_sharding"](spark, SMALL).collect()
    text = dict(documents)
    assert sorted(r.doc_id for r in rows) == sorted(text)
    slots = collections.defaultdict(list)
    for r in rows:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    plain, more = sharding.layout(), sharding.grown(sharding.layout())
    sample = spark.createDataFrame([(r.doc_id, "other text") for r in rows], "doc_id long, text string")
    again = {r.doc_id: r.shard for r in sharding.shard_documents(sample, plain).collect()}
    assert again == {r.doc_id: r.shard for r in rows}                     # doc_id and shard count decide
    moved = {r.doc_id: r.shard for r in sharding.shard_documents(sample, more).collect()}
    assert moved == {r.doc_id: r.grown_shard for r in rows}


def test_op4_brute_force(spark, documents):
    got = E.queries()["op4_quality_rules"](spark, SMALL)
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert table(got, *cols) == collections.Counter((i, *H.base_counts(t)) for i, t in documents)
    assert all(not (r.base_failed and r.kept) for r in got.collect())


def test_op5_brute_force(spark, documents):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = {i: enc.encode_ordinary(t or "") for i, t in documents}
    assert table(E.queries()["op5_byte_bpe"](spark, SMALL), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == \
        collections.Counter((i, len(ids[i]), H.sha(" ".join(map(str, ids[i]))), H.sha(t or "")) for i, t in documents)


def test_op9_brute_force(spark, documents):
    def text(spans):
        return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    expected = {i: H.personal(t) for i, t in documents}
    got = E.queries()["op9_pii"](spark, SMALL)
    cols = ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    assert table(got, *cols) == collections.Counter(
        (i, *[sum(k == n for _, k, _ in s) for n in range(4)], H.sha(text(s))) for i, s in expected.items())
    for r in got.collect():
        assert set(filter(None, text(expected[r.doc_id]).split(","))) <= set(r.spans.split(","))


def masked(text):
    out, at = "", 0
    for a, _, b in H.secrets(text):
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def test_pipeline_brute_force(spark, documents):
    """Every stage again in plain Python (the fitted field is taken over)."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    field = line_quality.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    rows = []
    for i, t in documents:
        d = line_quality.read_document(t)
        if not H.base_counts(t)[5] and field.content_share(d) >= 0.5:
            rows.append((i, t))
    rows = list(zip([i for i, _ in rows], H.line_kept(rows), strict=True))
    fps = {i: H.simhash(t, xxhash) for i, t in rows}
    root = H.groups(list(fps.values()), 3)
    low = {}
    for i, f in sorted(fps.items(), reverse=True):
        low[root[f]] = i
    rows = [(i, masked(t)) for i, t in rows if i in low.values()]
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    ids = {i: [*tok.encode(t, add_special_tokens=False).ids, 1] for i, t in rows}
    pieces = corpus_pipeline.run(spark, SMALL).collect()
    got = collections.defaultdict(list)
    for p in sorted(pieces, key=lambda p: p.start):
        assert p.start == len(got[p.doc_id]) and p.doc_tokens == len(ids[p.doc_id])
        got[p.doc_id] += [int.from_bytes(p.ids[k:k + 4], "little") for k in range(0, len(p.ids), 4)]
    assert dict(got) == ids


def test_stages_keep_the_columns_and_take_awkward_rows(spark):
    docs = H.frame(spark, H.AWKWARD)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        if name != "packing":
            assert out.columns == list(corpus_pipeline.COLUMNS), name
        out.collect()
        assert stage(spark, H.frame(spark, []), SMALL).count() == 0
