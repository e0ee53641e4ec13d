"""A Merkle manifest of a dataset by time-forward processing.

Each document is a leaf, each source a ternary tree over its leaves by doc_id, and
the sources' subroots are the leaves of one more tree, whose root stands for the
dataset. Nodes have labels (tree, end, level), where ``end`` is the first leaf
after the node's, so a sorted pass meets each node after its children. In the
forward sweep a node takes its children's digests from a priority queue ordered by
label and sends its own to its parent's label. In the reversed sweep, from the
highest label down, a node takes its proof suffix from the queue and sends each
child that child's siblings followed by the suffix; leaves fold it to the root.

The queue is external on two grounds. Time is cut into epochs of HEIGHT levels and
blocks of 3**HEIGHT nodes: a message to a later epoch goes through a table, which
Spark shuffles and sorts by label, and blocks run in parallel. A task's own queue
holds LIMIT messages and writes sorted runs to disk beyond that. Ranks of leaves
come from a range shuffle of (source, doc_id, digest), so a source that holds most
rows is split like any other; texts are never shuffled, and a proof exists only
while its leaf is folded.

Defined results: a null source is a source of its own before all others, a null
doc_id a leaf before all others of its source (never tampered with). Rows that
repeat a doc_id are leaves each, ordered by digest. A null text or column has the
digest of "-", which is not that of an empty text. Texts of any length are
digested whole. Other columns of the input are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

import heapq
import pickle
import tempfile
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import id_in, id_out, ready, rows, schema_of, stored

ARITY = 3
#: Levels of an epoch: a block has 3**HEIGHT nodes at its lowest level.
HEIGHT = 7
#: Messages that a task's queue keeps in memory.
LIMIT = 100_000


class MessageQueue:
    """An external priority queue: the least label first, then the least item."""

    def __init__(self, limit: int = LIMIT):
        self.limit, self.heap, self.runs = limit, [], []

    def __len__(self) -> int:
        return len(self.heap) + len(self.runs)

    def push(self, label: tuple, item: tuple) -> None:
        heapq.heappush(self.heap, (label, item))
        if len(self.heap) > self.limit:
            file = tempfile.TemporaryFile()
            for i in range(0, len(run := sorted(self.heap)), 1000):
                pickle.dump(run[i : i + 1000], file)
            file.seek(0)
            self.heap = []
            self._next(self._read(file), len(self.runs))

    @staticmethod
    def _read(file) -> Iterator[tuple]:
        with file:
            while True:
                try:
                    part = pickle.load(file)
                except EOFError:
                    return
                yield from part

    def _next(self, run: Iterator[tuple], k: int) -> None:
        if (head := next(run, None)) is not None:
            heapq.heappush(self.runs, (head, k, run))

    def _from_run(self) -> bool:
        return bool(self.runs) and (not self.heap or self.runs[0][0] < self.heap[0])

    def first(self) -> tuple:
        """The least label."""
        return (self.runs[0][0] if self._from_run() else self.heap[0])[0]

    def pop(self) -> tuple:
        """The item of the least label."""
        if not self._from_run():
            return heapq.heappop(self.heap)[1]
        head, k, run = heapq.heappop(self.runs)
        self._next(run, k)
        return head[1]


def depth(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    d, most = 0, 1
    while most < n:
        d, most = d + 1, most * ARITY
    return d


def _h(*hexes: str) -> str:
    return sha256("".join(hexes).encode()).hexdigest()


def ranked(df: DataFrame, tree: Column, order: list[str], name: str) -> DataFrame:
    """``df`` with tree, idx (rank in its tree by the columns ``order``) and n
    (size of its tree). ``tree``: a string without nulls."""
    order = ["tree", *order]
    held = df.withColumn("tree", tree).repartitionByRange(*order).sortWithinPartitions(*order)
    held = stored(held.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), name)
    runs = held.groupBy("part", "tree").agg(F.count("*").alias("c"), F.min("at").alias("low"))
    mine = W.partitionBy("tree")
    before = F.coalesce(F.sum("c").over(mine.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = runs.select("part", "tree", (before - F.col("low")).alias("shift"), F.sum("c").over(mine).alias("n"))
    return held.join(starts, ["part", "tree"]).withColumn("idx", F.col("at") + F.col("shift")).drop("part", "at", "shift")


_NODE = "tree string, n long, level long, end long, idx long, children binary, digest binary"


def _climb(nodes: DataFrame, base: int, height: int, limit: int) -> DataFrame:
    """The nodes above level ``base`` of an epoch: nodes (tree, n, idx, digest) at
    that level to _NODE rows; ``end`` counts nodes of level ``base``; digest: of
    nodes whose parent is in another epoch, else null."""
    out = schema_of(_NODE.replace(", ", ","))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue, got = MessageQueue(limit), []

        def send(tree: str, n: int, level: int, idx: int, digest: str) -> None:
            up = idx // ARITY
            queue.push((tree, (up + 1) * ARITY ** (level + 1 - base), level + 1), (idx % ARITY, up, n, digest))

        def upto(label: tuple | None) -> None:
            while queue and (label is None or queue.first() < label):
                tree, end, level = now = queue.first()
                children = []
                while queue and queue.first() == now:
                    _, idx, n, digest = queue.pop()
                    children.append(digest)
                own, top = _h(*children), level == min(base + height, depth(n))
                got.append((tree, n, level, end, idx, bytes.fromhex("".join(children)), bytes.fromhex(own) if top else None))
                if not top:
                    send(tree, n, level, idx, own)

        for b in batches:
            for tree, n, idx, digest in zip(*(c.to_pylist() for c in b.columns)):
                upto((tree, idx + 1, base))
                send(tree, n, base, idx, digest.hex())
            yield rows(out, *(list(zip(*got)) or [[]] * 7))
            got.clear()
        upto(None)
        yield rows(out, *(list(zip(*got)) or [[]] * 7))

    block = F.floor(F.col("idx") / ARITY**height)
    dealt = nodes.withColumn("block", block).repartition("tree", "block").sortWithinPartitions("tree", "idx")
    return dealt.select("tree", "n", "idx", "digest").mapInArrow(sweep, _NODE)


def climb(leaves: DataFrame, height: int = HEIGHT, limit: int = LIMIT) -> tuple[list[DataFrame], DataFrame]:
    """Forward sweep over a forest of leaves (tree, n, idx, digest): the nodes of
    each epoch, and (tree, digest) of each tree's root."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    now, epochs, roots = leaves.select("tree", "n", "idx", "digest"), [], leaves.filter("n = 1").select("tree", "digest")
    for base in range(0, depth(most), height):
        high = F.col("n") > F.lit(ARITY**base).cast("decimal(38,0)")
        epochs.append(stored(_climb(now.filter(high), base, height, limit), "nodes"))
        tops = epochs[-1].filter("digest is not null")
        done = F.col("n") <= F.lit(ARITY ** (base + height)).cast("decimal(38,0)")
        roots = roots.unionByName(tops.filter(done).select("tree", "digest"))
        now = tops.select("tree", "n", "idx", "digest")
    return epochs, roots


#: A suffix in a table: the subroot, then for each level left and right siblings.
def _text(subroot: str, path: tuple) -> str:
    out = [subroot]
    while path:
        left, right, path = path
        out.append(f"{left},{right}")
    return ";".join(out)


def _path(text: str) -> tuple[str, tuple]:
    subroot, *levels = text.split(";")
    path: tuple = ()
    for x in reversed(levels):
        path = (*x.split(","), path)
    return subroot, path


def fold(digest: str, path: tuple) -> str:
    """The root that a leaf with this digest and these siblings belongs to."""
    while path:
        left, right, path = path
        digest = _h(left, digest, right)
    return digest


def proof(path: tuple) -> str:
    """Digest of all siblings, level by level, left to right."""
    h = sha256()
    while path:
        left, right, path = path
        h.update((left + right).encode())
    return h.hexdigest()


_STEP = "tree string, level long, end long, idx long, children binary, suffix string, id long, leaf binary, tampered binary"
_FOUND = "tree string, idx long, suffix string"
_LEAF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _descend(steps: DataFrame, base: int, height: int, root: str | None, limit: int) -> DataFrame:
    """Reversed sweep over the nodes of an epoch, those of level ``base``
    included: _STEP rows, ``suffix`` given for the highest of each block. Without
    ``root`` (tree, idx, suffix) of each node of level ``base``, else leaves."""
    ddl = _LEAF if root else _FOUND
    out = schema_of(ddl.replace(", ", ","))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue, trees, kept, got = MessageQueue(limit), 0, None, []
        for b in batches:
            for tree, level, end, idx, children, suffix, i, leaf, tampered in zip(*(c.to_pylist() for c in b.columns)):
                if tree != kept:  # trees come in descending order, and so have ascending numbers
                    kept, trees = tree, trees + 1
                subroot, path = _path(suffix) if suffix is not None else queue.pop()
                if level > base:
                    hexes = [children[k : k + 32].hex() for k in range(0, len(children), 32)]
                    for k in range(len(hexes)):
                        child = idx * ARITY + k
                        label = (trees, -(child + 1) * ARITY ** (level - 1 - base), 1 - level)
                        queue.push(label, (subroot, ("".join(hexes[:k]), "".join(hexes[k + 1 :]), path)))
                elif root is None:
                    got.append((tree, idx, _text(subroot, path)))
                else:
                    end_at = fold(tampered.hex(), path)
                    got.append((i, leaf.hex(), subroot or leaf.hex(), root, proof(path), end_at, end_at == root))
            yield rows(out, *(list(zip(*got)) or [[]] * len(out)))
            got.clear()

    block = F.floor((F.col("end") - 1) / ARITY**height)
    dealt = steps.withColumn("block", block).repartition("tree", "block").sortWithinPartitions(F.desc("tree"), F.desc("end"), F.desc("level"))
    return dealt.select(*(c.split(" ")[0] for c in _STEP.split(", "))).mapInArrow(sweep, ddl)


def descend(leaves: DataFrame, epochs: list[DataFrame], given: DataFrame, root: str | None, height: int = HEIGHT, limit: int = LIMIT) -> DataFrame:
    """Reversed sweep over a forest: leaves (tree, n, idx, id, leaf, tampered) and
    the nodes of ``climb``. ``given`` (tree, suffix): what each root starts from."""
    none = {"children": F.lit(None).cast("binary"), "id": F.lit(None).cast("long"), "leaf": F.lit(None).cast("binary"), "tampered": F.lit(None).cast("binary")}
    above, alone = None, leaves.filter("n = 1").select("tree", "idx").join(given, "tree")
    for e in range(len(epochs) - 1, -1, -1):
        base, own = e * height, epochs[e]
        tops = own.filter("digest is not null")
        done = F.col("n") <= F.lit(ARITY ** (base + height)).cast("decimal(38,0)")
        start = tops.filter(done).select("tree", "level", "idx").join(given, "tree")
        if above is not None:
            start = start.unionByName(tops.filter(~done).select("tree", "level", "idx").join(above, ["tree", "idx"]))
        inner = own.select("tree", "level", "end", "idx", "children").join(start, ["tree", "level", "idx"], "left").withColumns({k: v for k, v in none.items() if k != "children"})
        if e:
            low = epochs[e - 1].filter(F.col("digest").isNotNull() & (F.col("n") > F.lit(ARITY**base).cast("decimal(38,0)"))).select("tree", "idx").withColumns(none)
            steps = inner.unionByName(low.withColumns({"level": F.lit(base).cast("long"), "end": F.col("idx") + 1, "suffix": F.lit(None).cast("string")}))
            above = stored(_descend(steps, base, height, None, limit), "suffixes")
        else:
            above = inner
    low = leaves.select("tree", "idx", "n", "id", "leaf", "tampered", none["children"].alias("children"), F.lit(0).cast("long").alias("level"), (F.col("idx") + 1).alias("end"))
    low = low.filter("n > 1").drop("n").withColumn("suffix", F.lit(None).cast("string")).unionByName(low.filter("n = 1").drop("n").join(alone, ["tree", "idx"]))
    return _descend(low.unionByName(above) if above is not None else low, 0, height, root, limit)


def _field(c: Column) -> Column:
    return F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(_field, (doc_id, source, lang, n_chars, text))), 256))


def manifest(docs: DataFrame, height: int = HEIGHT, limit: int = LIMIT) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each
    row of ``docs`` (doc_id, source, lang, n_chars, text). folded_root: the root
    that its proof gives if the line feeds of texts whose doc_id has an even crc32
    (as decimal text) were deleted."""
    spark = docs.sparkSession
    ready(spark)
    i, source, text = F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")
    rest = lambda t: leaf_digest(i, source, F.col("lang"), F.col("n_chars"), t)
    changed = F.coalesce(F.crc32(i.cast("string").cast("binary")) % 2 == 0, F.lit(False)) & (F.instr(text, "\n") > 0)
    tree = F.coalesce(F.concat(F.lit("s"), source), F.lit(""))
    own = docs.select(tree.alias("tree"), id_in(i).alias("id"), rest(text).alias("leaf"), F.when(changed, rest(F.replace(text, F.lit("\n"), F.lit("")))).alias("other"))
    leaves = ranked(own, F.col("tree"), ["id", "leaf"], "leaves").withColumn("tampered", F.coalesce("other", "leaf"))
    epochs, subroots = climb(leaves.withColumn("digest", F.col("leaf")), height, limit)
    sources = ranked(subroots.select(F.col("tree").alias("of"), "digest"), F.lit(""), ["of"], "sources")
    above, root = climb(sources, height, limit)
    root = root.first()
    if root is None:
        return spark.createDataFrame([], _LEAF)
    start = spark.createDataFrame([("", ";".join([""]))], "tree string, suffix string")
    blank = F.lit(None).cast("binary")
    paths = descend(sources.select("tree", "n", "idx", F.lit(0).cast("long").alias("id"), blank.alias("leaf"), blank.alias("tampered")), above, start, None, height, limit)
    names = sources.select("idx", F.col("of").alias("tree"), F.lower(F.hex("digest")).alias("subroot"))
    # A suffix of a source starts with its subroot.
    given = names.join(paths.select("idx", "suffix"), "idx").select("tree", F.concat("subroot", "suffix").alias("suffix"))
    got = descend(leaves.select("tree", "n", "idx", "id", "leaf", "tampered"), epochs, stored(given, "given"), root["digest"].hex(), height, limit)
    return got.withColumn("doc_id", id_out())
