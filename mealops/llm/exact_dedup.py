"""Exact dedup with Patricia-trie owners (operator 3).

1. Every task inserts its texts, as whole byte strings, into compressed radix
   tries, one per length; a terminal node owns one text and keeps its largest
   document id, its count and its SHA-256. One row per owned text leaves the
   task, so a text with very many copies leaves each task once.
2. Those rows are partitioned by (length, content hash) and inserted into
   the owner tries of the partition, again as whole byte strings.
3. A task whose tries outgrow ``trie_bytes`` (edge bytes and a fixed cost per
   node and owner) spills subtrees, the largest of the largest tries first,
   down to half of that: the owned texts below go out as partial rows, and
   the nodes are freed. Partial rows of one text meet again in the last
   aggregate, on (length, SHA-256).
4. The owners are joined back to the documents on (length, SHA-256).

Every owned text leaves with a second hash; the last aggregate raises an error
if two different byte strings carry one (length, SHA-256), spilled or not,
instead of merging them.

Defined cases: null text counts as empty; null ids never keep a group unless
all of its ids are null (then all its rows stay); rows that repeat the kept
id and text are all kept, being the same document; empty table -> empty
result; extra columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_named, text_of, written


# Bytes that CPython takes beside an edge's text: a node with its edge, and an owner with its digest.
_NODE_BYTES = 400
_OWNER_BYTES = 260


class Node:
    """A node of a compressed radix trie: edges by first byte, and the owner if a text ends here."""

    __slots__ = ("edges", "owner")

    def __init__(self):
        self.edges: dict[int, tuple[bytes, Node]] | None = None
        self.owner: list | None = None        # [largest id, count, sha256]


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix (binary search over slices, compared in C)."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Trie:
    """Owners of byte strings; ``held`` is the memory it takes, ``sizes`` that of each subtree below the root."""

    def __init__(self):
        self.root, self.sizes, self.held = Node(), {}, 0

    def _grown(self, first: int, by: int) -> None:
        self.sizes[first] = self.sizes.get(first, 0) + by
        self.held += by

    def insert(self, text: bytes) -> Node:
        node, rest = self.root, text
        while rest:
            if node.edges is None:
                node.edges = {}
            found = node.edges.get(rest[0])
            if found is None:
                leaf = Node()
                node.edges[rest[0]] = (rest, leaf)
                self._grown(text[0], len(rest) + _NODE_BYTES)
                return leaf
            label, child = found
            if rest.startswith(label):
                node, rest = child, rest[len(label):]
                continue
            n = _common(label, rest)
            fork = Node()
            fork.edges = {label[n]: (label[n:], child)}
            node.edges[rest[0]] = (label[:n], fork)
            self._grown(text[0], _NODE_BYTES)
            node, rest = fork, rest[n:]
        return node

    def add(self, text: bytes, doc: int | None, count: int, sha: str | None = None) -> None:
        node = self.insert(text)
        if node.owner is None:
            node.owner = [doc, count, sha or hashlib.sha256(text).hexdigest()]
            if text:
                self._grown(text[0], _OWNER_BYTES)
            else:
                self.held += _OWNER_BYTES
        else:
            own = node.owner
            own[0] = own[0] if doc is None else doc if own[0] is None else max(own[0], doc)
            own[1] += count

    @staticmethod
    def _below(top: Node, prefix: bytes) -> Iterator[tuple[bytes, list]]:
        """The owned texts of a subtree; the nodes are freed on the way."""
        stack = [(top, prefix)]
        while stack:
            node, path = stack.pop()
            if node.owner is not None:
                yield path, node.owner
                node.owner = None
            for label, child in (node.edges or {}).values():
                stack.append((child, path + label))
            node.edges = None

    def spill(self) -> Iterator[tuple[bytes, list]]:
        """Drain the largest subtree below the root."""
        if not self.sizes:
            return
        first = max(self.sizes, key=self.sizes.get)
        label, child = self.root.edges.pop(first)
        self.held -= self.sizes.pop(first)
        yield from self._below(child, label)

    def drain(self) -> Iterator[tuple[bytes, list]]:
        """All owned texts; the trie is empty afterwards."""
        while self.sizes:
            yield from self.spill()
        if self.root.owner is not None:
            yield b"", self.root.owner
            self.root.owner = None
        self.held = 0


_OWNED = pa.schema([("len", pa.int64()), ("sha", pa.string()), ("text", pa.binary()), ("doc", pa.int64()),
                    ("n", pa.int64()), ("mark", pa.int64())])
_OWNED_SQL = "len long, sha string, text binary, doc long, n long, mark long"


def _mark(text: bytes) -> int:
    """A second hash of a text, signed."""
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _owners(trie_bytes: int, keep_text: bool):
    """Batches of (text, doc[, n, sha]) -> owned texts; partial rows where tries spilled."""

    def out(owned: list[tuple[bytes, list]]) -> pa.RecordBatch:
        return pa.record_batch([
            pa.array([len(t) for t, _ in owned], pa.int64()), pa.array([o[2] for _, o in owned], pa.string()),
            pa.array([t if keep_text else None for t, _ in owned], pa.binary()),
            pa.array([o[0] for _, o in owned], pa.int64()), pa.array([o[1] for _, o in owned], pa.int64()),
            pa.array([None if keep_text else _mark(t) for t, _ in owned], pa.int64()),
        ], schema=_OWNED)

    def chunks(owned: Iterator[tuple[bytes, list]]) -> Iterator[pa.RecordBatch]:
        part, size = [], 0
        for t, o in owned:
            part.append((t, o))
            size += len(t)
            if size > 4 << 20 or len(part) >= 5000:
                yield out(part)
                part, size = [], 0
        if part:
            yield out(part)

    def spilled(tries: dict[int, Trie], held: int) -> Iterator[tuple[bytes, list]]:
        """Subtrees of the largest tries, until half of the limit is free."""
        for length in sorted(tries, key=lambda n: tries[n].held, reverse=True):
            trie = tries[length]
            held -= trie.held
            while trie.held and held + trie.held > trie_bytes // 2:
                if trie.sizes:
                    yield from trie.spill()
                else:
                    yield from trie.drain()
            held += trie.held
            if not trie.held:
                del tries[length]
            if held <= trie_bytes // 2:
                return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[int, Trie] = {}
        held = 0
        for batch in batches:
            ids = batch.column(1).to_pylist()
            counts = batch.column(2).to_pylist() if batch.num_columns > 2 else None
            shas = batch.column(3).to_pylist() if batch.num_columns > 2 else None
            for i, text in enumerate(batch.column(0)):
                body = text.as_buffer().to_pybytes() if text.is_valid else b""
                trie = tries.get(len(body))
                if trie is None:
                    trie = tries[len(body)] = Trie()
                before = trie.held
                trie.add(body, ids[i], counts[i] if counts else 1, shas[i] if shas else None)
                held += trie.held - before
                if held > trie_bytes:
                    yield from chunks(spilled(tries, held))
                    held = sum(t.held for t in tries.values())
        for length in list(tries):
            yield from chunks(tries.pop(length).drain())

    return run


def owners(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", trie_bytes: int = 128 << 20) -> DataFrame:
    """One row per different text: (len, sha, keep_id, group_size). ``trie_bytes`` bounds a task's tries."""
    d = rows_named(docs, doc_id, text)
    local = (d.select(text_of(d, text).cast("binary"), F.col(doc_id).cast("long"))
             .mapInArrow(_owners(trie_bytes, keep_text=True), _OWNED_SQL))
    owned = (local.repartition("len", "sha").select("text", "doc", "n", "sha")
             .mapInArrow(_owners(trie_bytes, keep_text=False), _OWNED_SQL))
    two = F.concat(F.lit("two texts with SHA-256 "), F.col("sha"))
    return (owned.groupBy("len", "sha").agg(F.max("doc").alias("keep_id"), F.sum("n").alias("group_size"),
                                            F.min("mark").alias("low"), F.max("mark").alias("high"))
            .select("len", "sha", "keep_id",
                    F.when(F.col("low") == F.col("high"), F.col("group_size")).otherwise(F.raise_error(two).cast("long"))
                    .alias("group_size")))


def dedup_exact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", trie_bytes: int = 128 << 20) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) per row; the largest id of equal texts stays."""
    d = rows_named(docs, doc_id, text)
    body = text_of(d, text)
    named = d.select(F.col(doc_id), F.octet_length(body).cast("long").alias("len"), F.sha2(body, 256).alias("sha"))
    # The owners are a table of their own, so that the join can split a text with very many copies.
    owned = written(owners(docs, doc_id, text, trie_bytes), "text-owners")
    return (named.join(owned, ["len", "sha"])
            .select(doc_id, "keep_id", "group_size",
                    F.col(doc_id).cast("long").eqNullSafe(F.col("keep_id")).alias("kept"),
                    F.col("sha").alias("text_sha256")))
