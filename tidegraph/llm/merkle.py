"""Merkle manifests of datasets, kept as postorder append logs.

Every row is a leaf, the digest of its fields. The leaves of a group (a source) stand
in one order under a tree whose nodes have three children, the last of a level maybe
fewer; the groups' roots are the leaves of a last tree. A node's digest is that of its
children's hexadecimal digests.

Leaves are dealt to builders in aligned units of ``UNIT`` (a power of three), so a
unit is a whole subtree. A builder appends a node to its log when the last leaf below
it has arrived, which is postorder; units above units are built the same way. The
place of a node in the log follows from the sizes of the subtrees that were complete
before it, without looking at the log (``postorder``). So a proof is read from the log
by computed places: first the part of the path inside the unit, then the parts above.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.ordered import dense_index
from ..storage import Scratch, new_path, stored
from .common import join_counted, release, trimmed

ARITY = 3
UNIT = ARITY**8
OWN = "*"  # Stands for the node itself in a path.


def height(n: int, arity: int = ARITY) -> int:
    """The levels above ``n`` leaves: 0 for one leaf."""
    h = 0
    while n > 1:
        n, h = -(-n // arity), h + 1
    return h


def postorder(level: np.ndarray, index: np.ndarray, n: np.ndarray, top: int, arity: int = ARITY) -> np.ndarray:
    """Places in the postorder log of the nodes ``index`` of ``level`` in trees of ``n`` leaves and ``top`` levels.

    A node is complete when the last leaf below it has arrived. Until then each level
    had completed as many nodes as its size divides the leaves, and the last node of
    a level, which may be short, with the last leaf. Nodes that are complete with the
    same leaf follow each other from the lower to the higher level.
    """
    level, index, n = (np.asarray(x, np.int64) for x in (level, index, n))
    arrived = np.minimum((index + 1) * arity**level, n)
    place = np.full(arrived.shape, -1, np.int64)
    for h in range(top + 1):
        size = arity**h
        now = np.where(h <= level, arrived, arrived - 1)
        place += np.where(now < n, now // size, -(-n // size))
    return place


def node_digest(children: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(children)).hexdigest().encode()


def subtree(leaves: list[bytes], top: int, arity: int = ARITY) -> list[list[bytes]]:
    """The levels of a subtree of ``top`` levels, the leaves first."""
    levels = [leaves]
    for _ in range(top):
        below = levels[-1]
        levels.append([node_digest(below[i : i + arity]) for i in range(0, len(below), arity)])
    return levels


def append_log(leaves: list[bytes], top: int, arity: int = ARITY) -> list[bytes]:
    """The nodes of a subtree in the order in which they are complete."""
    levels = subtree(leaves, top, arity)
    log: list[bytes | None] = [None] * sum(len(nodes) for nodes in levels)
    for h, nodes in enumerate(levels):
        places = postorder(np.full(len(nodes), h), np.arange(len(nodes)), np.full(len(nodes), len(leaves)), top, arity)
        for place, digest in zip(places.tolist(), nodes):
            log[place] = digest
    return log


def path_places(index: int, n: int, top: int, arity: int = ARITY) -> list[tuple[int, list[int]]]:
    """For each level: the node's place in its run, and the log places of the run's nodes."""
    steps, count = [], n
    for h in range(top):
        first = index - index % arity
        run = np.arange(first, min(first + arity, count))
        places = postorder(np.full(len(run), h), run, np.full(len(run), n), top, arity)
        steps.append((index - first, places.tolist()))
        index, count = index // arity, -(-count // arity)
    return steps


def path_text(log: list[bytes], index: int, n: int, top: int, arity: int = ARITY) -> str:
    """The path from a leaf to the top of its subtree: runs parted by |, their digests by commas, the own one as *."""
    return "|".join(
        ",".join(OWN if i == own else log[p].decode() for i, p in enumerate(places))
        for own, places in path_places(index, n, top, arity)
    )


def subtree_paths(log: list[bytes], n: int, top: int, above: str = "", arity: int = ARITY) -> list[str]:
    """The paths of all leaves of a subtree, each followed by ``above``: places are computed once per level.

    A node's path is its run and then its parent's path, so every level adds one run to the paths above it.
    """
    sizes = [n]
    for _ in range(top):
        sizes.append(-(-sizes[-1] // arity))
    paths = [above]
    for h in range(top - 1, -1, -1):
        count = sizes[h]
        places = postorder(np.full(count, h), np.arange(count), np.full(count, n), top, arity)
        texts, longer = [log[p].decode() for p in places.tolist()], []
        for parent, first in enumerate(range(0, count, arity)):
            run = texts[first : first + arity]
            rest = f"|{paths[parent]}" if paths[parent] else ""
            longer += [",".join([*run[:k], OWN, *run[k + 1 :]]) + rest for k in range(len(run))]
        paths = longer
    return paths


def folded(leaf: str, path: str) -> str:
    """The root that a leaf and a path lead to."""
    node = leaf
    for run in path.split("|") if path else []:
        node = hashlib.sha256(run.replace(",", "").replace(OWN, node).encode()).hexdigest()
    return node


def field(value: Column | str) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon, the value."""
    text = (F.col(value) if isinstance(value, str) else value).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column | str) -> Column:
    """The digest of a row's fields, in lowercase hexadecimal."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


@dataclass(frozen=True)
class Manifest:
    """``leaves``: the rows given, with group (null as ""), tree, index and n, the leaves of its tree.
    ``log``: (layer, tree, unit, first, nodes), of each unit the nodes in postorder. ``roots``: (tree, group, n, digest).
    """

    leaves: DataFrame
    log: DataFrame
    top_log: DataFrame
    roots: DataFrame
    top_rank: DataFrame
    unit: int

    @property
    def root(self) -> DataFrame:
        """One row: the digest of the whole dataset. No row for an empty one."""
        return self.top_log.where("is_top").select(F.element_at("nodes", -1).alias("root"))

    def nodes(self) -> DataFrame:
        """(layer, tree, place, digest): the append log of the groups' trees, a row per node."""
        spread = self.log.select("layer", "tree", "first", F.posexplode("nodes").alias("k", "digest"))
        return spread.select("layer", "tree", (F.col("first") + F.col("k")).alias("place"), "digest")


def _shard(unit: int) -> Column:
    """The task of a leaf: that of the first leaf of its unit in the order of all trees."""
    first = F.col("start") + F.col("index") - F.pmod("index", F.lit(unit))
    return F.floor(first / unit).cast("bigint").alias("shard")


def build_units(leaves: DataFrame, unit: int) -> DataFrame:
    """(tree, unit, n_units, first, nodes): the log of every aligned unit of ``leaves`` (tree, index, n, start, digest).

    ``start`` is the place of the tree's first leaf in the order of all trees: units that start near
    each other share a task, so that many small trees are few groups, and a group holds less than two units.
    """

    def build(table: pa.Table) -> pa.Table:
        tree, index, n = (table.column(c).to_numpy() for c in ("tree", "index", "n"))
        digest = table.column("digest").to_pylist()
        order = np.lexsort((index, tree))
        tree, index, n = tree[order], index[order], n[order]
        of = index // unit
        cuts = np.flatnonzero((np.diff(tree) != 0) | (np.diff(of) != 0)) + 1
        out, shard = [], table.column("shard")[0].as_py()
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(order)]):
            units = -(-int(n[a]) // unit)
            # The only unit of a tree ends at its root, others at the level of whole units.
            top = height(unit) if units > 1 else height(int(n[a]))
            log = append_log([digest[i].encode() for i in order[a:b]], top)
            first = int(postorder(np.zeros(1), index[a : a + 1], n[a : a + 1], height(int(n[a])))[0])
            out.append((shard, int(tree[a]), int(of[a]), units, first, [x.decode() for x in log]))
        columns = list(zip(*out))
        kinds = [pa.int64()] * 5 + [pa.list_(pa.string())]
        names = ["shard", "tree", "unit", "n_units", "first", "nodes"]
        return pa.table({c: pa.array(x, k) for c, x, k in zip(names, columns, kinds)})

    dealt = leaves.select("tree", "index", "n", "digest", _shard(unit))
    return dealt.groupBy("shard").applyInArrow(
        trimmed(build), "shard bigint, tree bigint, unit bigint, n_units bigint, first bigint, nodes array<string>"
    )


def build_log(leaves: DataFrame, unit: int, scratch: Scratch) -> DataFrame:
    """Stored (layer, tree, unit, n_units, first, nodes, is_top): the logs of all units, and of the units above them.

    Layers grow with the logarithm of the largest tree to the base ``unit``: two for 43 million rows.
    """
    path, layer = new_path(leaves.sparkSession, "merkle-log"), 0
    current, spark = leaves, leaves.sparkSession
    while True:
        built = build_units(current, unit).select(
            F.lit(layer).alias("layer"), "*", (F.col("n_units") == 1).alias("is_top")
        )
        built.write.mode("append").parquet(path)
        log = spark.read.schema(built.schema).parquet(path)
        above = log.where(f"layer = {layer} AND n_units > 1")
        if above.isEmpty():
            scratch.paths[log] = path
            return log
        # Trees of several units only; each has at most one row per whole unit.
        tops = above.select(
            "tree", F.col("unit").alias("index"), F.col("n_units").alias("n"), F.element_at("nodes", -1).alias("digest")
        )
        sizes = tops.groupBy("tree").agg(F.first("n").alias("__n"))
        earlier = Window.orderBy("tree").rowsBetween(Window.unboundedPreceding, -1)
        starts = sizes.select("tree", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("start"))
        current, layer = tops.join(starts, "tree"), layer + 1


def build_manifest(
    docs: DataFrame, digest: Column, group: str, order: str, scratch: Scratch, unit: int = UNIT, keep: tuple[str, ...] = ()
) -> Manifest:
    """The manifest of the rows: trees by ``group`` (null first, then by UTF-8 bytes), leaves by ``order``.

    Rows that are equal in group and order stand in the order of their digests; ``keep`` names columns to carry along.
    """
    rows = docs.select(
        *keep,
        F.col(group).isNotNull().alias("known"),
        F.coalesce(F.col(group).cast("string"), F.lit("")).cast("binary").alias("group"),
        F.col(order).alias("order"),
        digest.alias("digest"),
    )
    # Equal rows are told apart, so that any number of them is spread over the parts.
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    placed = dense_index(rows, ["known", "group", "order", "digest", "tie"], keep=scratch.stored).drop("tie")
    trees = placed.groupBy("known", "group").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("start"))
    # Groups may be as many as rows: they are numbered as rows are.
    trees = scratch.stored(dense_index(trees, ["known", "group"], "tree", scratch.stored), "trees")
    joined = join_counted(placed, trees, ["known", "group"], "inner")
    leaves = scratch.stored(
        joined.select(*keep, "order", "digest", "tree", (F.col("position") - F.col("start")).alias("index"), "n", "start"),
        "leaves",
    )
    log = build_log(leaves, unit, scratch)
    tops = log.where("is_top").select("tree", F.element_at("nodes", -1).alias("digest"))
    total = trees.count()
    rank = scratch.stored(
        tops.select(
            F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("index"), F.lit(total).cast("bigint").alias("n"),
            F.lit(0).cast("bigint").alias("start"), "digest",
        ),
        "subroots",
    )
    top_log = build_log(rank, unit, scratch)
    return Manifest(leaves, log, top_log, trees.join(tops, "tree"), rank, unit)


def unit_paths(leaves: DataFrame, log: DataFrame, above: DataFrame | None, unit: int, carried: list[str]) -> DataFrame:
    """(tree, index, path, ...carried) of every leaf; ``above``: (tree, unit, path) of the units themselves.

    Each unit's log meets its leaves: a group is one unit, whatever the size of its tree.
    """
    logs = log.select("shard", "tree", "unit", "n_units", "nodes")
    if above is not None:
        logs = join_counted(logs, above, ["tree", "unit"]).withColumn("path", F.coalesce("path", F.lit("")))
    else:
        logs = logs.withColumn("path", F.lit(""))
    # Units are dealt as in building: near ones share a group, since most trees may be small.
    places = leaves.select("tree", "index", "n", _shard(unit), *carried)
    fields = "tree bigint, index bigint, path string" + "".join(
        f", {c} {leaves.schema[c].dataType.simpleString()}" for c in carried
    )

    def read(mine: pa.Table, found: pa.Table) -> pa.Table:
        tree, index, n = (mine.column(c).to_numpy() for c in ("tree", "index", "n"))
        size_of = dict(zip(tree.tolist(), n.tolist()))
        rows = zip(*[found.column(f"log_{c}").to_pylist() for c in ("tree", "unit", "n_units", "nodes", "path")])
        paths_of = {}
        for t, u, units, nodes, rest in rows:
            total = size_of[t]
            top = height(unit) if units > 1 else height(total)
            size = min(total - u * unit, unit)
            paths_of[t, u] = subtree_paths([x.encode() for x in nodes], size, top, rest)
        paths = [paths_of[t, i // unit][i % unit] for t, i in zip(tree.tolist(), index.tolist())]
        table = mine.select(["tree", "index"]).append_column("path", pa.array(paths, pa.string()))
        for c in carried:
            table = table.append_column(c, mine.column(c))
        release()
        return table

    logs = logs.select(*[F.col(c).alias(f"log_{c}") for c in logs.columns])
    return places.groupBy("shard").cogroup(logs.groupBy("log_shard")).applyInArrow(read, fields)


def _all_paths(leaves: DataFrame, log: DataFrame, unit: int, carried: list[str], scratch: Scratch, above=None) -> DataFrame:
    """Paths of leaves to the roots of their trees, from the highest layer down; ``above``: (tree, path) of the trees."""
    layers = log.agg(F.max("layer")).first()[0] or 0
    paths = None if above is None else above
    for layer in range(layers, -1, -1):
        mine = log.where(f"layer = {layer}")
        tops = mine.where("n_units = 1").select("tree", "unit")
        if above is not None:
            # Of this layer, the trees that end here go on with the path of the tree.
            ends = tops.join(above, "tree").select("tree", "unit", "path")
            lower = ends if layer == layers else ends.unionByName(paths)
        else:
            lower = None if layer == layers else paths
        if layer == 0:
            return unit_paths(leaves, mine, lower, unit, carried)
        below = log.where(f"layer = {layer - 1} AND n_units > 1")
        starts = below.groupBy("tree").agg(F.first("n_units").alias("n"))
        earlier = Window.orderBy("tree").rowsBetween(Window.unboundedPreceding, -1)
        starts = starts.select("tree", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
        units = below.select("tree", F.col("unit").alias("index"), F.col("n_units").alias("n")).join(starts, "tree")
        found = unit_paths(units, mine, lower, unit, [])
        paths = scratch.stored(found.select("tree", F.col("index").alias("unit"), "path"), "unit-paths")
    raise AssertionError


def proofs(manifest: Manifest, carried: list[str], scratch: Scratch) -> DataFrame:
    """(tree, index, path, ...carried): for every leaf the path to the root of the whole dataset.

    A path holds the runs from the leaf up, parted by |, in each the digests from left to right, the own one as *.
    """
    trees = _all_paths(manifest.top_rank, manifest.top_log, manifest.unit, [], scratch)
    trees = scratch.stored(trees.select(F.col("index").alias("tree"), "path"), "tree-paths")
    return _all_paths(manifest.leaves, manifest.log, manifest.unit, carried, scratch, trees)


def fold_paths(df: DataFrame, leaf: str, path: str, name: str) -> DataFrame:
    """``df`` with the root that each row's leaf and path lead to."""

    @F.arrow_udf("string")
    def fold(leaves: pa.Array, paths: pa.Array) -> pa.Array:
        return pa.array([folded(a, b) for a, b in zip(leaves.to_pylist(), paths.to_pylist())], pa.string())

    return df.withColumn(name, fold(F.col(leaf), F.col(path)))


def verified_manifest(
    docs: DataFrame, fields: tuple[str, ...], group: str, order: str, tampered: dict[str, Column], unit: int = UNIT
) -> DataFrame:
    """A row per row: ``order``, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``tampered`` gives columns another value; the leaf of the changed row is folded with the original siblings.
    Null values have a digest of their own; null groups are the first tree, null orders its first leaves. Repeated
    rows are leaves each, rows equal in group and order stand by their digests. Other columns are ignored, whatever
    their names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        rows = docs.select(
            F.col(group).alias("__group"),
            F.col(order).alias("__order"),
            leaf_digest(*fields).alias("__leaf"),
            leaf_digest(*[tampered.get(c, c) for c in fields]).alias("__changed"),
        )
        rows = scratch.stored(rows, "leaf-digests")
        manifest = build_manifest(rows, F.col("__leaf"), "__group", "__order", scratch, unit, ("__changed",))
        if manifest.leaves.isEmpty():
            return spark.createDataFrame([], _result_schema(docs.schema[order].dataType.simpleString()))
        root = manifest.root.first()["root"]
        found = proofs(manifest, ["order", "digest", "__changed"], scratch)
        subroots = manifest.roots.select("tree", F.col("digest").alias("subroot"))
        subroots = scratch.stored(subroots, "subroots")
        named = join_counted(fold_paths(found, "__changed", "path", "folded_root"), subroots, ["tree"])
        result = named.select(
            F.col("order").alias("doc_id"),
            F.col("digest").alias("leaf"),
            "subroot",
            F.lit(root).alias("root"),
            F.sha2(F.regexp_replace("path", "[*,|]", ""), 256).alias("proof_sha256"),
            "folded_root",
            (F.col("folded_root") == F.lit(root)).alias("verified"),
        )
        return stored(result, "merkle-proofs")


def _result_schema(kind: str) -> str:
    texts = ", ".join(f"{c} string" for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root"))
    return f"doc_id {kind}, {texts}, verified boolean"
