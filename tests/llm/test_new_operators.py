"""Conversation prefix trie, nearest neighbours and importance resampling against plain re-computations."""

import collections
import hashlib
import math
import random
import re
import zlib

import helpers as H
import numpy as np
import pytest
from pyspark.sql import functions as F

from mealops.llm import ann, prefix_trie, resample
from mealops.llm.parens import Parens, RangeMin

TURNS = "conv_id long, turn long, role string, text string"


# -- balanced parentheses -------------------------------------------------

def random_tree(r: random.Random, n: int, deep: float) -> tuple[list[int], list[int]]:
    """Bits of a random tree and the closing place of every opening one."""
    bits, close, stack = [1], {}, [0]
    while len(close) < n:
        if len(close) + len(stack) < n and (len(stack) < 2 or r.random() < deep):
            stack.append(len(bits))
            bits.append(1)
        elif len(stack) > 1 or len(close) == n - 1:
            close[stack.pop()] = len(bits)
            bits.append(0)
        else:
            stack.append(len(bits))
            bits.append(1)
    return bits, [close[i] for i in sorted(close)]


@pytest.mark.parametrize("n,deep", [(1, .5), (2, .5), (300, .3), (5000, .5), (5000, .9), (3000, 1.0)])
def test_find_close_and_leaf_rank(n, deep):
    bits, close = random_tree(random.Random(n), n, deep)
    tree = Parens(np.array(bits, np.uint8))
    assert tree.find_close(tree.opens).tolist() == close
    leaves = np.cumsum([0] + [a == 1 and b == 0 for a, b in zip(bits, bits[1:])])
    assert tree.leaves_before(tree.opens).tolist() == leaves[tree.opens].tolist()


def test_range_min():
    values = np.random.default_rng(1).integers(0, 1000, 77)
    a, b = np.array([(i, j) for i in range(77) for j in range(i + 1, 78)]).T
    assert RangeMin(values)(a, b).tolist() == [values[i:j].min() for i, j in zip(a, b, strict=True)]


# -- conversation prefix trie ---------------------------------------------

def trie_by_hand(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(v, key=lambda t: t[:2])] for c, v in own.items()}
    convs = {}
    for c, v in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))
        convs[c] = tuple(turns.get(base, [])[:h] + v[h:])
    nodes = collections.defaultdict(list)
    for c, v in convs.items():
        for d in range(len(v) + 1):
            nodes[v[:d]].append(c)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[:len(p)] == p]
        childless = [q for q in below if not any(len(x) == len(q) + 1 and x[:len(q)] == q for x in below)]
        saved = sum((len(nodes[q]) - 1) * (len(q[-1][1]) if q else 0) for q in below)
        ends = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(p))))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members),
                    sum(len(q) == len(p) + 1 for q in below), len(childless), saved, H.sha(ends)))
    return collections.Counter(out)


def random_turns(seed: int, convs: int, hot: float):
    r = random.Random(seed)
    rows = []
    for c in range(convs):
        if r.random() < hot:
            rows += [(c, t, "user", f"same {t}") for t in range(3)]
        else:
            rows += [(c, t, r.choice("ua"), r.choice(("", "é", "a", "b")) * r.randint(0, 2)) for t in range(r.randint(1, 6))]
    r.shuffle(rows)
    return rows


AWKWARD_TURNS = [(None, 1, "u", "lost"), (1, None, None, None), (1, 0, "u", ""), (1, 2, "u", "x" * 30_000), (7, 3, "u", "é日"),
                 (-5, 1, "u", "minus"), (-100, 0, "a", "base of minus"), (205, 1, "u", "no base"), (300, 1, "u", "t"),
                 (301, 1, "u", "t"), (399, 1, None, "t")] + [(300, t, "u", f"turn {t}") for t in range(2, 40)]


@pytest.mark.parametrize("rows", [random_turns(1, 120, .4), random_turns(2, 40, 0), random_turns(3, 90, 1.0), AWKWARD_TURNS],
                         ids=["hot", "plain", "all equal", "awkward"])
@pytest.mark.parametrize("per_shard", [8, 65_536])
def test_trie(spark, rows, per_shard):
    df = spark.createDataFrame(rows, TURNS).withColumn("key", F.lit("clash")).withColumn("low", F.lit(1)).withColumn(
        "n", F.lit(2)).withColumn("turns", F.lit(3)).withColumn("base", F.lit(4)).repartition(5)
    got = prefix_trie.prefix_trie(df, per_shard=per_shard)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                           "ends_sha256"]
    assert collections.Counter(map(tuple, got.collect())) == trie_by_hand(rows)


def test_trie_of_ends_in_many_pieces(spark):
    """A node at which more conversations end than fit into a piece, over several shards."""
    rows = [(100 * c, 0, "u", "one") for c in range(3000)]
    got = {r.depth: r for r in prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS), per_shard=700).collect()}
    ids = [100 * c for c in range(3000)]
    assert got[1].n_convs == 3000 and got[1].ends_sha256 == H.sha(",".join(map(str, ids)))
    assert (got[0].n_leaves, got[0].saved_tokens, got[0].ends_sha256) == (1, 2999 * 3, H.sha(""))


def test_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    with pytest.raises(ValueError):
        prefix_trie.trie(None, per_shard=2)


# -- nearest neighbours ---------------------------------------------------

def near_by_hand(rows, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for n, q in enumerate(ids.tolist()):
        if q % 20 == 0:
            s = x @ x[n]
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
            out[q] = [(int(ids[j]), s[j]) for j in order]
    return out


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, "x")
                                  for i, v in rows], "vec_id long, embedding array<float>, id int, vec string")


def recall(spark, rows, **fitting):
    got = collections.defaultdict(list)
    for r in ann.search(vectors(spark, rows), F.col("id") % 20 == 0, **fitting).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    want, hits, n = near_by_hand(rows, 20), 0, 0
    value = dict(rows)
    for q, best in want.items():
        own = sorted(got[q])
        assert [x[0] for x in own] == list(range(1, len(best) + 1))
        assert [(-s, i) for _, i, s in own] == sorted((-s, i) for _, i, s in own)
        for _, i, s in own:
            assert i != q and s == pytest.approx(float(np.dot(value[q], value[i])), abs=1e-9)
        hits += len({i for _, i, _ in own} & {i for i, _ in best})
        n += len(best)
    assert set(got) == {q for q in want if want[q]}
    return hits / n


def float_rows(x):
    return [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]


def test_neighbours_of_clusters_and_noise(spark):
    r = np.random.default_rng(3)
    centers = r.standard_normal((40, 32))
    x = centers[r.integers(0, 40, 3000)] + .3 * r.standard_normal((3000, 32))
    assert recall(spark, float_rows(x), block_rows=50) >= .9                    # many blocks a list
    assert recall(spark, float_rows(r.standard_normal((3000, 32)) * r.lognormal(0, .5, (3000, 1)))) >= .9


def test_neighbours_of_copies(spark):
    """A third of the rows are one vector: ties go to the smallest ids."""
    r = np.random.default_rng(4)
    x = r.standard_normal((900, 16))
    x[::3] = x[0]
    rows = float_rows(x)
    got = {(q.query_id, q["rank"]): q.vec_id for q in ann.search(vectors(spark, rows), F.col("id") % 20 == 0).collect()}
    assert [got[0, i] for i in range(1, 21)] == [3 * i for i in range(1, 21)]
    assert [got[60, i] for i in range(1, 21)] == [3 * i for i in range(0, 20)]
    assert recall(spark, rows) >= .9


def test_neighbours_awkward(spark):
    good = [(0, [1, 0]), (20, [0, 2]), (3, [1, 1]), (4, [1, 1]), (40, [-1, -1])]
    bad = [(60, None), (5, [0, 0]), (80, [None, 1]), (6, [math.nan, 1]), (7, [math.inf, 1]), (8, [1, 2, 3]), (100, [])]
    got = ann.search(vectors(spark, good + bad + [(3, [1, 1])]).unionByName(
        vectors(spark, [(1, [9, 9])]).withColumn("vec_id", F.lit(None).cast("long"))), F.col("id") % 20 == 0)
    assert [tuple(r) for r in got.orderBy("query_id", "rank").collect()] == [
        (0, 1, 3, 1.0), (0, 2, 4, 1.0), (0, 3, 20, 0.0), (0, 4, 40, -1.0),
        (20, 1, 3, 2.0), (20, 2, 4, 2.0), (20, 3, 0, 0.0), (20, 4, 40, -2.0),
        (40, 1, 0, -1.0), (40, 2, 3, -2.0), (40, 3, 4, -2.0), (40, 4, 20, -2.0)]
    assert ann.search(vectors(spark, []), F.col("id") % 20 == 0).count() == 0
    assert ann.search(vectors(spark, bad[:2]), F.col("id") % 20 == 0).count() == 0


# -- importance resampling ------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features_by_hand(text, max_run):
    words = WORD.findall(H.lower(text or ""))
    return len(words), [zlib.crc32(" ".join(words[i:i + n]).encode()) for n in range(1, max_run + 1)
                        for i in range(len(words) - n + 1)]


def resample_by_hand(rows, target, max_run, buckets, percent):
    docs = [(i, *features_by_hand(t, max_run)) for i, t in rows]
    s = collections.Counter(f % buckets for _, _, fs in docs for f in fs)
    t = collections.Counter(f % buckets for x in target for f in features_by_hand(x, max_run)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.) * (ns + buckets) / ((s[b] + 1.) * (nt + buckets)))) for b in range(buckets)]
    out = []
    for i, n, fs in docs:
        w = sum(gain[f % buckets] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + .5) / 4294967296))), n])
    drawable = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): p + 1 for p, r in enumerate(drawable[:len(drawable) * percent // 100])}
    return collections.Counter((*r[:4], rank.get(id(r))) for r in out)


@pytest.mark.parametrize("max_run,buckets,percent", [(1, 10_000, 10), (2, 500, 50), (3, 65_536, 100), (1, 7, 0)])
def test_resample(spark, max_run, buckets, percent):
    rows = H.AWKWARD + [(100 + i, H.prose(i, 5 + i)) for i in range(60)] + [(100, H.prose(0, 30))] * 3
    target = [H.prose(i, 25) for i in range(0, 60, 3)] + [None, "", "É é 日本語 x"]
    got = resample.resample(H.frame(spark, rows).withColumn("score", F.lit("clash")).withColumn("rank", F.lit(1)).repartition(4),
                            spark.createDataFrame([(t, 1) for t in target], "text string, features int"),
                            max_run=max_run, buckets=buckets, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert collections.Counter(map(tuple, got.collect())) == resample_by_hand(rows, target, max_run, buckets, percent)


def test_resample_of_nothing(spark):
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert resample.resample(nothing, nothing).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert resample.resample(one, nothing).select("n_features", "rank").collect() == [(2, None)]
    with pytest.raises(ValueError):
        resample.resample(one, nothing, buckets=70_000)


def test_runs_do_not_cross_texts():
    """The words of a buffer are found together; runs over a text's end are masked."""
    texts = [b"a b", b"", b"c", b"d e f", b"", b" g"]
    got = resample.Featurizer(2, 65_536)(texts)
    assert [(n, sorted(x.tolist())) for n, x in got] == [
        (n, sorted(f % 65_536 for f in fs)) for n, fs in (features_by_hand(t.decode(), 2) for t in texts)]
