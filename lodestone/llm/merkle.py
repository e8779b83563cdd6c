"""A manifest of a table as trees of hashes, with a proof for every row.

Rows are leaves, in one tree per group and by their order in it; the roots of these
trees are the leaves of a last one. Every ``fanout`` consecutive nodes have a parent,
the hash of their hashes in order; a last run may be shorter.

A level is a self-join: nodes meet those at the sibling indices computed from their
own, by exclusive or with one in a binary tree and by offsets from their slot
otherwise, and the nodes in slot zero give the parents. Each level is stored, so no plan
grows with the height. Rows get their indices from a sort by ranges: a task numbers
the rows it holds, and sums over tasks, one number per task and tree, say how many
come before; no tree has to fit in a task.

The hash of a proof needs all siblings up to the root in one place. They go down
the trees in blocks of a few levels: the steps of a block are one row, which meets
the path above it once and gives the paths of all nodes at its foot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import whole_row
from lodestone.session import scratch_path, stored

FANOUT = 2
_FOOT = 256  # nodes at the foot of a block, at most

_STEP = "tree string, idx long, n long, hash string, before string, after string"


def digest(*parts: Column) -> Column:
    """SHA-256, in lower-case hexadecimal digits, of texts one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(column: Column) -> Column:
    """A value as text with its length in bytes before it, so that no two rows look alike; null is ``-``."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def tree_key(column: Column) -> Column:
    """A name per group that is never null and sorts as the groups do, null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("-"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``idx``, their place in their ``tree``, and ``n``, the rows of that tree.

    ``order`` must order the rows of a tree totally. The rows are sorted by ranges over
    tree and order, so that one tree may span many tasks.
    """
    keys = ["tree", *order]
    place = F.monotonically_increasing_id()
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_place", place)
    ordered = stored(ordered, "ordered").withColumn("_task", F.shiftright("_place", 33))
    tasks = ordered.groupBy("tree", "_task").agg(F.min("_place").alias("_first"), F.count("*").alias("_rows"))
    tree = W.partitionBy("tree")
    ahead = tree.orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    # One row per task and tree in it: as many as there are tasks and trees together.
    tasks = stored(
        tasks.select(
            "tree",
            "_task",
            (F.coalesce(F.sum("_rows").over(ahead), F.lit(0)) - F.col("_first")).alias("_shift"),
            F.sum("_rows").over(tree).alias("n"),
        ),
        "task-rows",
    )
    joined = ordered.join(tasks, ["tree", "_task"])
    return joined.withColumn("idx", F.col("_place") + F.col("_shift")).drop("_task", "_place", "_shift")


@dataclass(frozen=True)
class Trees:
    """All nodes of trees: ``level, tree, idx, n, hash, before, after, own``.

    ``n`` is the number of nodes of the tree at that level; ``before`` and ``after`` are the
    hashes of a node's siblings on either side, joined, null if there are none;
    ``own`` are further columns of a leaf, null above.
    """

    steps: DataFrame
    height: int
    fanout: int

    def roots(self) -> DataFrame:
        """``tree, level, hash``: the last node of every tree."""
        return self.steps.filter("n = 1").select("tree", "level", "hash")


def _with_siblings(nodes: DataFrame, fanout: int) -> DataFrame:
    slot = F.col("idx") % fanout
    rows = nodes
    found = []
    for shift in range(1, fanout):
        place = (slot + shift) % fanout
        sibling = F.col("idx").bitwiseXOR(F.lit(1)) if fanout == 2 else F.col("idx") - slot + place
        other = nodes.select(
            F.col("tree").alias("_tree"), F.col("idx").alias("_idx"), F.col("hash").alias(f"_hash{shift}")
        )
        rows = rows.join(other, (F.col("tree") == F.col("_tree")) & (sibling == F.col("_idx")), "left")
        rows = rows.drop("_tree", "_idx")
        found.append(F.when(F.col(f"_hash{shift}").isNotNull(), F.struct(place.alias("slot"), F.col(f"_hash{shift}").alias("hash"))))
    siblings = F.array_sort(F.array_compact(F.array(*found)))

    def joined(side) -> Column:
        text = F.array_join(F.transform(F.filter(siblings, side), lambda s: s["hash"]), "")
        return F.when(text != "", text)

    return rows.withColumns(
        {"before": joined(lambda s: s["slot"] < slot), "after": joined(lambda s: s["slot"] > slot)}
    )


def grow(leaves: DataFrame, fanout: int = FANOUT) -> Trees:
    """Trees over leaves ``tree, idx, n, hash, own``; a lone leaf is its tree's root."""
    spark = leaves.sparkSession
    path = scratch_path(spark, "trees")
    kind = leaves.schema["own"].dataType.simpleString()
    ddl = f"{_STEP}, own {kind}"
    columns = [c.split()[0] for c in ddl.split(", ")[:6]] + ["own"]
    nodes = leaves.select("tree", "idx", "n", "hash", "own")
    size = leaves.agg(F.max("n")).first()[0] or 0
    height = 0
    while True:
        _with_siblings(nodes, fanout).select(*columns).write.parquet(f"{path}/level={height}")
        if size <= 1:
            break
        below = spark.read.schema(ddl).parquet(f"{path}/level={height}")
        nodes = below.filter((F.col("n") > 1) & (F.col("idx") % fanout == 0)).select(
            "tree",
            F.expr(f"idx div {fanout}").alias("idx"),
            F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"),
            digest(F.col("hash"), F.coalesce("after", F.lit(""))).alias("hash"),
            F.lit(None).cast(kind).alias("own"),
        )
        size, height = -(-size // fanout), height + 1
    steps = spark.read.schema(f"{ddl}, level int").parquet(path)
    return Trees(steps, height, fanout)


def paths(trees: Trees, above: DataFrame) -> DataFrame:
    """``own, hash, top, path`` of every leaf.

    ``above`` has, per tree, ``tree, level`` of its root, ``top``, handed down to all leaves,
    and the ``path`` from the root on. A path lists, from the leaf up, the siblings
    ``before, after`` of each node that has a parent.
    """
    f = trees.fanout
    b = 1
    while f ** (b + 1) <= _FOOT:
        b += 1
    handed = None
    for group in reversed(range(trees.height // b + 1)):
        foot = group * b
        inside = (F.col("level") >= foot) & (F.col("level") < foot + b)
        steps = trees.steps.filter(inside)
        # The ancestor of a node at the head of its block, and the first node under it at the same level.
        span = F.element_at(F.array(*[F.lit(f ** (b - k)) for k in range(b)]), F.col("level") - foot + 1)
        steps = steps.withColumn("_span", span).withColumn("block", F.expr("idx div _span"))
        kept = ["idx", "n", "before", "after", *(["hash", "own"] if group == 0 else [])]
        levels = [
            F.array_sort(F.collect_list(F.when(F.col("level") == foot + k, F.struct(*(kept if k == 0 else kept[:4])))),
                         lambda x, y: F.signum(x["idx"] - y["idx"]).cast("int")).alias(f"_level{k}")
            for k in range(b)
        ]
        blocks = steps.groupBy("tree", "block").agg(*levels)
        first = above.filter((F.col("level") >= foot) & (F.col("level") < foot + b)).select(
            "tree", F.lit(0).cast("long").alias("block"), "top", "path"
        )
        if handed is not None:
            first = first.unionByName(handed)
        met = blocks.join(first, ["tree", "block"])

        def path(node):
            """Steps of a node at the foot, level by level, then those above the block."""
            own = [
                F.get(f"_level{k}", F.floor((node["idx"] - F.col("block") * f**b) / f**k).cast("int"))
                for k in range(b)
            ]
            steps = F.filter(F.array(*[F.when(s["n"] > 1, F.struct(s["before"].alias("before"), s["after"].alias("after"))) for s in own]),
                             lambda s: s.isNotNull())
            return F.concat(steps, F.col("path"))

        columns = ["hash", "own"] if group == 0 else ["idx"]
        nodes = F.transform("_level0", lambda x: F.struct(*[x[c].alias(c) for c in columns], path(x).alias("path")))
        out = met.select("tree", "top", F.inline(nodes))
        if group:
            handed = stored(out.select("tree", F.col("idx").alias("block"), "top", "path"), "paths")
    return out.select("own", "hash", "top", "path")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path lead to."""
    empty = F.lit("")
    return F.aggregate(
        path, leaf, lambda h, s: digest(F.coalesce(s["before"], empty), h, F.coalesce(s["after"], empty))
    )


def siblings(path: Column) -> Column:
    """All siblings of a path as one text, level by level, left to right."""
    empty = F.lit("")
    return F.array_join(F.transform(path, lambda s: F.concat(F.coalesce(s["before"], empty), F.coalesce(s["after"], empty))), "")


def manifest(
    docs: DataFrame,
    fields: list[str],
    tree: str,
    order: str,
    fanout: int = FANOUT,
    changed: dict[str, Column] | None = None,
    changed_where: Column | None = None,
) -> DataFrame:
    """``order, leaf, changed_leaf, subroot, root, path`` of every row of ``docs``.

    A leaf is the hash of the row's ``fields``; there is one tree per value of ``tree``, nulls
    together, and one over their roots, null first, then by bytes. ``changed`` replaces
    columns of the rows that ``changed_where`` holds for, and ``changed_leaf`` is the leaf this
    gives (null for other rows), to be held against the tree of the original rows.

    Rows with a null ``order`` come first; rows with equal ones, repeated rows among them, are
    leaves each, ordered by their hash. Null fields differ from empty ones. Whole texts are
    hashed, whatever their length. Other columns don't matter, and an empty table gives
    no rows.
    """
    if fanout < 2:
        raise ValueError("a tree needs a fanout of 2 or more")
    row = docs.select(whole_row(docs).alias("r"))
    leaf = digest(*[field(F.col("r")[c]) for c in fields])
    after = changed or {}
    altered = digest(*[field(after.get(c, F.col("r")[c])) for c in fields])
    where = F.coalesce(changed_where, F.lit(False)) if changed_where is not None else F.lit(False)
    leaves = stored(
        row.select(
            tree_key(F.col("r")[tree]).alias("tree"),
            F.col("r")[order].alias("at"),
            leaf.alias("hash"),
            F.when(where, altered).alias("changed_leaf"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "leaves",
    )
    own = F.struct(F.col("at"), F.col("changed_leaf")).alias("own")
    trees = grow(numbered(leaves, ["at", "hash", "row"]).select("tree", "idx", "n", "hash", own), fanout)
    roots = stored(trees.roots(), "roots")
    last = roots.select(F.lit("").alias("tree"), F.col("tree").alias("at"), "level", "hash")
    own = F.struct("at", "level").alias("own")
    over = grow(numbered(last, ["at"]).select("tree", "idx", "n", "hash", own), fanout)
    nothing = F.array().cast("array<struct<before:string,after:string>>")
    ends = over.roots().select("tree", "level", F.col("hash").alias("top"), nothing.alias("path"))
    above = paths(over, ends).select(
        F.col("own.at").alias("tree"),
        F.col("own.level").alias("level"),
        F.struct(F.col("hash").alias("subroot"), F.col("top").alias("root")).alias("top"),
        "path",
    )
    every = paths(trees, stored(above, "above"))
    return every.select(
        F.col("own.at").alias(order),
        F.col("hash").alias("leaf"),
        F.col("own.changed_leaf").alias("changed_leaf"),
        "top.subroot",
        "top.root",
        "path",
    )
