"""Conversation prefix trie in balanced parentheses (operator 11).

A node is a distinct sequence of the first d turns of the conversations; the
textless root has d = 0.

1. *Paths.* Every turn becomes a digest of (role, text) and a length, so no
   text is shuffled. A conversation's path is the concatenation of its turns'
   digests; the order of paths is a depth-first order of the trie.
2. *Shards.* Paths are range-partitioned by (path, conversation), so a group
   of equal conversations spreads over as many shards as it fills. A task
   reads its shard in order and writes its part of the trie as balanced
   parentheses (``parens``). ``find_close`` delimits every subtree, the rank
   of leaf pairs counts its leaves, cumulative arrays over the nodes give
   members and savings, and a range minimum the smallest member.
3. *Spines.* Only nodes on the path of a shard's first or last conversation
   can have members elsewhere. All others are final and leave as rows. The
   two spines leave as one row each: a path with, per depth, what hangs below
   it within the shard.
4. *Merge.* Spines are entries like conversations, so the same step merges
   them: sorted and sharded again until one shard holds them all (two rows a
   shard, so each pass is smaller by the size of a shard).
5. The ids of conversations that end at a spine node leave in pieces of
   ascending ids, and a streaming hash per node puts them together; ids that
   end elsewhere are hashed in place. Children of spine nodes get their
   parent's id by a join.

Defined cases: rows without a conversation id belong to no conversation;
null role or text is read as empty; turns go by number, null first, then by
digest; repeated rows are repeated turns; conversations without turns are
members of the root only; an empty table -> empty result; other columns are
not carried. A conversation's digests are one value (24 bytes a turn).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_small, rows_named, written
from .parens import Parens, RangeMin

_TURN = 24                         # characters of a turn's digest in a path
_NONE = np.iinfo(np.int64).max
_PIECE = 512                       # ids in one piece of a spine node's ends
_LOT = 20_000
_EMPTY = hashlib.sha256().hexdigest()
_COUNTS = ("members", "children", "leaves", "saved")

_NODE = {"conv_id": "long", "depth": "long", "parent_conv_id": "long", "n_convs": "long", "n_children": "long",
         "n_leaves": "long", "saved_tokens": "long", "ends_sha256": "string", "path": "string", "parent_path": "string"}
_ENTRY = {"key": "string", "tie": "long", "lens": "array<int>", "low": "array<long>",
          **{c: "array<long>" for c in _COUNTS}}
_PART = {"at": "string", "first_id": "long", "ids": "string"}
_ALL = {"kind": "string", **_NODE, **_ENTRY, **_PART}
_ARROW = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()),
          "array<long>": pa.list_(pa.int64())}
_SCHEMA = pa.schema([(c, _ARROW[t]) for c, t in _ALL.items()])


def digest(role: Column, text: Column) -> Column:
    """A turn's 24 characters: the first 18 bytes of a SHA-256, which no other (role, text) shares in practice."""
    whole = F.concat_ws(":", F.length(role).cast("string"), F.concat(role, text))
    return F.base64(F.unhex(F.substring(F.sha2(whole, 256), 1, 36)))


def conversations(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, turns array<struct<turn, digest, n>>): one row a conversation, its turns in order."""
    d = rows_named(rows, conv_id, turn, role, text)
    who, what = (F.coalesce(d[c].cast("string"), F.lit("")) for c in (role, text))
    one = F.struct(d[turn].cast("long").alias("turn"), digest(who, what).alias("digest"),
                   F.length(what).alias("n"))
    return (d.select(F.col(conv_id).cast("long").alias("conv_id"), one.alias("one")).where("conv_id is not null")
            .groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns")))


def rebuilt(convs: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Every conversation c opens with the first h turns of conversation c - c % group, h = crc32(c) % most,
    and goes on with its own turns after its first h."""
    head = F.slice("turns", 1, most - 1)
    heads = convs.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), head.alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    c = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).withColumn("h", h)
    first = F.when(F.col("head").isNotNull() & (F.col("h") > 0), F.slice("head", 1, F.greatest("h", F.lit(1))))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    empty = F.slice("turns", 1, 0)
    return c.join(heads, "base", "left").select("conv_id", F.concat(F.coalesce(first, empty), rest).alias("turns"))


def entries(convs: DataFrame) -> DataFrame:
    """Conversations as (key, tie, lens): the path, the conversation, and the length of each turn."""
    return convs.select(F.array_join(F.transform("turns", lambda t: t["digest"]), "").alias("key"),
                        F.col("conv_id").alias("tie"), F.transform("turns", lambda t: t["n"]).alias("lens"))


class Shard:
    """The trie of one shard, filled with entries in path order."""

    def __init__(self, digests: bool):
        self.key, self.path, self.bits = "", [], bytearray()             # path: the open nodes, by depth
        self.depth, self.length, self.parent = [], [], []                # by node
        self.first_key, self.first = "", []
        self.at, self.low = [], []                                       # what hangs directly below a node
        self.counts: dict[str, list[int]] = {c: [] for c in _COUNTS}
        self.names: dict[int, str] | None = {} if digests else None      # node -> digest of its path
        self.hashes: list = []

    def enter(self, key: str, lens: list[int]) -> None:
        """Close and open nodes up to the end of the path ``key``."""
        keep = 0
        if self.path:
            shared = min(len(key), len(self.key)) // _TURN
            turns = 0
            while turns < shared and key[turns * _TURN:(turns + 1) * _TURN] == \
                    self.key[turns * _TURN:(turns + 1) * _TURN]:
                turns += 1
            keep = turns + 1
            self.bits += b"\0" * (len(self.path) - keep)
            del self.path[keep:]
        for d in range(keep, len(lens) + 1):
            self.parent.append(self.path[-1] if d else 0)
            self.path.append(len(self.depth))
            self.depth.append(d)
            self.length.append(lens[d - 1] if d else 0)
        self.bits += b"\1" * (len(lens) + 1 - keep)
        if self.names is not None:
            del self.hashes[keep:]
            for d in range(keep, len(lens) + 1):
                self.hashes.append(_extended(self.hashes[-1] if d else None, key, d))
                self.names[self.path[d]] = self.hashes[-1].hexdigest()[:32]
        if not self.first:
            self.first, self.first_key = list(self.path), key
        self.key = key

    def add(self, node: int, low: int, members: int, children: int = 0, leaves: int = 0, saved: int = 0) -> None:
        self.at.append(node)
        self.low.append(low)
        for values, n in zip(self.counts.values(), (members, children, leaves, saved), strict=True):
            values.append(n)

    def totals(self) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        """By node: what hangs directly below it, and what its whole subtree in this shard holds."""
        n, at = len(self.depth), np.array(self.at, np.int64)
        own = {c: np.zeros(n, np.int64) for c in _COUNTS}
        for c, values in self.counts.items():
            np.add.at(own[c], at, np.array(values, np.int64))
        own["low"] = np.full(n, _NONE)
        np.minimum.at(own["low"], at, np.array(self.low, np.int64))
        tree = Parens(np.frombuffer(bytes(self.bits) + b"\0" * len(self.path), np.uint8), own["children"] == 0)
        close = tree.find_close(tree.opens)
        start = np.arange(n)
        stop = start + (close - tree.opens + 1) // 2

        def within(values: np.ndarray) -> np.ndarray:
            sums = np.concatenate(([0], np.cumsum(values)))
            return sums[stop] - sums[start]

        members = within(own["members"])
        parent = np.array(self.parent, np.int64)
        return own, {"members": members, "low": RangeMin(own["low"])(start, stop), "parent": parent,
                     "children": own["children"] + np.bincount(parent[1:], minlength=n),
                     "leaves": tree.leaves_before(close) - tree.leaves_before(tree.opens) + within(own["leaves"]),
                     "saved": within((members - 1) * np.array(self.length, np.int64) + own["saved"])}


def _extended(h, key: str, depth: int):
    """The running hash of a path's first ``depth`` turns, from that of one turn less."""
    h = h.copy() if h else hashlib.sha256()
    if depth:
        h.update(key[(depth - 1) * _TURN:depth * _TURN].encode())
    return h


def _names(key: str, nodes: list[int]) -> dict[int, str]:
    out, h = {}, None
    for d, node in enumerate(nodes):
        h = _extended(h, key, d)
        out[node] = h.hexdigest()[:32]
    return out


def _batch(kind: str, n: int, columns: dict) -> pa.RecordBatch:
    columns = {"kind": [kind] * n, **columns}
    return pa.record_batch([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type)
                            for f in _SCHEMA], schema=_SCHEMA)


def _finished(shard: Shard, ends: dict[int, list[int]], last: bool) -> Iterator[pa.RecordBatch]:
    """What leaves a filled shard: its final nodes, its spines, and the ends of spine nodes."""
    own, all_ = shard.totals()
    n = len(shard.depth)
    spine = np.zeros(n, bool)
    if not last:
        spine[shard.first] = spine[shard.path] = True
    names = shard.names or {**_names(shard.first_key, shard.first), **_names(shard.key, shard.path)}
    parent = all_["parent"]
    by_name = spine[parent] if n else spine                  # the parent's members are not all here
    for a in range(0, n, _LOT):
        i = a + np.flatnonzero(~spine[a:a + _LOT])
        has = (i > 0) & ~by_name[i]
        hashed = [_EMPTY if shard.names is None else None] * len(i)
        if ends:
            hashed = [hashlib.sha256(",".join(map(str, ends.get(k, ()))).encode()).hexdigest() for k in i.tolist()]
        yield _batch("node", len(i), {
            "conv_id": all_["low"][i], "depth": np.array(shard.depth, np.int64)[i],
            "parent_conv_id": pa.array(all_["low"][parent[i]], mask=~has), "n_convs": all_["members"][i],
            "n_children": all_["children"][i], "n_leaves": all_["leaves"][i], "saved_tokens": all_["saved"][i],
            "ends_sha256": hashed, "path": [shard.names[k] if shard.names else None for k in i.tolist()],
            "parent_path": [names[p] if lost else None for p, lost in zip(parent[i].tolist(), by_name[i], strict=True)]})
    if last:
        return
    child = np.flatnonzero(~spine & by_name)
    for c, values in (("members", all_["members"]), ("children", np.ones(n, np.int64)), ("leaves", all_["leaves"]),
                      ("saved", all_["saved"])):
        np.add.at(own[c], parent[child], values[child])
    np.minimum.at(own["low"], parent[child], all_["low"][child])
    sides = [(shard.first_key, shard.first, 0)]
    if shard.path != shard.first:
        same = sum(a == b for a, b in zip(shard.first, shard.path, strict=False))
        sides.append((shard.key, shard.path, same))          # the shared part is told by the first side
    for key, nodes, skip in sides:
        cells = {c: [0] * skip + own[c][nodes[skip:]].tolist() for c in (*_COUNTS, "low")}
        yield _batch("spine", 1, {"key": [key], "tie": [min(own["low"][nodes[skip:]].tolist(), default=0)],
                                  "lens": [[shard.length[k] for k in nodes[1:]]], **{c: [v] for c, v in cells.items()}})
    for node in sorted(set(shard.first) | set(shard.path)):
        ids = ends.get(node, [])
        cuts = range(0, len(ids), _PIECE)
        if ids:
            yield _batch("ends", len(cuts), {"at": [names[node]] * len(cuts), "first_id": [ids[c] for c in cuts],
                                             "ids": [",".join(map(str, ids[c:c + _PIECE])) for c in cuts]})


def _fold(spines_in: bool, last: bool):
    """Sorted entries of a shard (conversations, or spines of earlier shards) -> rows of ``_SCHEMA``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ends = Shard(digests=spines_in), {}
        for batch in batches:
            cols = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                key = cols["key"][i].as_py()
                if not shard.path or key != shard.key:
                    shard.enter(key, cols["lens"][i].as_py())
                if spines_in:
                    cells = [cols[c][i].as_py() for c in ("low", *_COUNTS)]
                    for node, (low, members, *rest) in zip(shard.path, zip(*cells, strict=True), strict=True):
                        if members:
                            shard.add(node, low, members, *rest)
                else:
                    tie = cols["tie"][i].as_py()
                    shard.add(shard.path[-1], tie, 1)
                    ends.setdefault(shard.path[-1], []).append(tie)
        if shard.path:
            yield from _finished(shard, ends, last)

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by (path, first id) -> the hash of each path's comma-joined ids; one piece is held at a time."""
    at, h = None, None
    for batch in batches:
        done: list[tuple[str, str]] = []
        for path, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if path != at:
                if h:
                    done.append((at, h.hexdigest()))
                at, h = path, hashlib.sha256()
            else:
                h.update(b",")
            h.update(ids.as_py().encode())
        yield pa.record_batch([pa.array([p for p, _ in done], pa.string()), pa.array([x for _, x in done], pa.string())],
                              names=["at", "hash"])
    if h:
        yield pa.record_batch([pa.array([at]), pa.array([h.hexdigest()])], names=["at", "hash"])


def trie(convs: DataFrame, per_shard: int = 65_536) -> DataFrame:
    """``convs`` (conv_id, turns array<struct<digest, n>>): one row per node of their prefix trie.

    Shards hold about ``per_shard`` entries (8 at least); there are as many as the cores, or more.
    """
    if per_shard < 8:
        raise ValueError("per_shard must be 8 at least")
    spark = convs.sparkSession
    cores = spark.sparkContext.defaultParallelism
    schema = ", ".join(f"{c} {t}" for c, t in _ALL.items())
    now = written(entries(convs), "trie-paths")
    n, levels = now.count(), []
    while True:
        shards = -(-n // per_shard)
        last = bool(levels) and shards <= 1
        if last:                                                # at most ``per_shard`` spines, in one task
            dealt = now.coalesce(1)
        else:
            dealt = now.repartitionByRange(max(1, shards, 0 if levels else cores), "key", "tie")
        levels.append(written(dealt.sortWithinPartitions("key", "tie").mapInArrow(_fold(bool(levels), last), schema),
                              "trie-level"))
        if last:
            break
        now = levels[-1].where("kind = 'spine'").select(*_ENTRY)
        n = now.count()
    nodes = [x.where("kind = 'node'").select(*_NODE) for x in levels]
    upper = nodes[1]
    for x in nodes[2:]:
        upper = upper.unionByName(x)
    pieces = levels[0].where("kind = 'ends'").select("at", "ids", "first_id")
    hashes = (pieces.repartition(max(cores, -(-pieces.count() // _LOT)), "at").sortWithinPartitions("at", "first_id")
              .mapInArrow(_hashed, "at string, hash string"))
    upper = written(upper.join(hashes, upper["path"] == hashes["at"], "left")
                    .withColumn("ends_sha256", F.coalesce("hash", F.lit(_EMPTY))).select(*_NODE), "trie-upper")
    known = broadcast_small(written(upper.select(F.col("path").alias("of"), F.col("conv_id").alias("parent")),
                                    "trie-parents"))
    out = [c for c in _NODE if c not in ("path", "parent_path")]
    every = nodes[0].unionByName(upper)
    lost = every.where("parent_path is not null").join(known, F.col("parent_path") == F.col("of"))
    return every.where("parent_path is null").select(*out).unionByName(
        lost.withColumn("parent_conv_id", F.col("parent")).select(*out))


def prefix_trie(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                text: str = "text", per_shard: int = 65_536) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) per node of the
    trie of the rebuilt conversations; ``conv_id`` is a node's smallest member."""
    return trie(rebuilt(conversations(rows, conv_id, turn, role, text)), per_shard)
