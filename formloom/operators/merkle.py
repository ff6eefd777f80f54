"""Checksums of datasets as stored hash trees.

A member's place is the SHA-256 of its name, so members spread evenly whatever their names look like. Leaves are
the ranges of names that share the first ``depth`` hex digits of their place; a leaf's digest is the order-free sum
of its members' hashes, so no leaf is ever gathered. An inner node hashes its children (sixteen at most) in order,
up to the root. The formula does not depend on the number of members.

The tree is a table (depth, prefix, digest, members) of at most 16^depth leaves. After a change only the leaves it
touches and the nodes above them are hashed again, and two trees are compared from the root downwards, reading
below differing nodes only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formloom.functions.identity import multiset_digest
from formloom.session import cut

DEPTH = 4
TREE = ["depth", "prefix", "digest", "members"]


def place(name: str) -> Column:
    """Where a member stands in the tree."""
    return F.sha2(F.col(name), 256)


def _leaves(members: DataFrame, name: str, digest: str, depth: int) -> DataFrame:
    own = F.sha2(F.concat_ws("\x00", F.col(name), F.col(digest)), 256)
    rows = members.select(F.substring(place(name), 1, depth).alias("prefix"), own.alias("_h"))
    return rows.groupBy("prefix").agg(multiset_digest("_h").alias("digest"), F.count(F.lit(1)).alias("members")).select(
        F.lit(depth).alias("depth"), "prefix", "digest", "members"
    )


def _parents(level: DataFrame, depth: int) -> DataFrame:
    """The nodes of ``depth`` over the given nodes one level below."""
    children = F.array_sort(F.collect_list(F.struct("prefix", "digest")))
    joined = F.array_join(F.transform(children, lambda c: F.concat_ws("=", c["prefix"], c["digest"])), ";")
    return level.groupBy(F.substring("prefix", 1, depth).alias("_up")).agg(
        F.sha2(joined, 256).alias("digest"), F.sum("members").alias("members")
    ).select(F.lit(depth).alias("depth"), F.col("_up").alias("prefix"), "digest", "members")


def build(members: DataFrame, name: str, digest: str, depth: int = DEPTH) -> DataFrame:
    """The tree over members (a name and a digest each; names should not repeat). Without members there is no node."""
    level = cut(_leaves(members, name, digest, depth), "tree-leaves")
    tree = level
    for d in range(depth - 1, -1, -1):
        level = _parents(level, d)
        tree = tree.unionByName(level)
    return cut(tree, "tree")


def root(tree: DataFrame) -> DataFrame:
    """(checksum, members) of the whole dataset; one row, also for an empty one."""
    top = tree.filter("depth = 0")
    return top.agg(F.coalesce(F.max("digest"), F.sha2(F.lit(""), 256)).alias("checksum"), F.coalesce(F.max("members"), F.lit(0)).alias("members"))


def refresh(tree: DataFrame, members: DataFrame, touched: DataFrame, name: str, digest: str, depth: int = DEPTH) -> DataFrame:
    """The tree after a change: ``members`` as they are now, ``touched`` the names added, removed or changed.

    Only members in touched leaves are hashed, and only nodes above those leaves.
    """
    stale = cut(touched.select(F.substring(place(name), 1, depth).alias("prefix")).distinct(), "tree-touched")
    near = members.withColumn("_leaf", F.substring(place(name), 1, depth)).join(stale.withColumnRenamed("prefix", "_leaf"), "_leaf", "left_semi")
    level, kept = cut(_leaves(near, name, digest, depth), "tree-leaves"), tree.filter(F.col("depth") == depth)
    out = kept.join(stale, "prefix", "left_anti").select(*TREE).unionByName(level)
    below = cut(out, "tree-level")
    parts = [below]
    for d in range(depth - 1, -1, -1):
        stale = stale.select(F.substring("prefix", 1, d).alias("prefix")).distinct()
        mine = below.join(stale.withColumnRenamed("prefix", "_up"), F.substring("prefix", 1, d) == F.col("_up"), "left_semi")
        fresh = _parents(mine, d)
        below = cut(tree.filter(F.col("depth") == d).join(stale, "prefix", "left_anti").select(*TREE).unionByName(fresh), "tree-level")
        parts.append(below)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def differences(first: DataFrame, second: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(prefix, first_members, second_members) of the leaves in which two trees differ; a missing leaf has none.

    Goes down level by level, below differing nodes only.
    """
    at: DataFrame | None = None
    for d in range(depth + 1):
        a, b = (t.filter(F.col("depth") == d).select("prefix", "digest", "members") for t in (first, second))
        if at is not None:
            up = at.select(F.col("prefix").alias("_up"))
            a, b = (t.join(up, F.substring("prefix", 1, d - 1) == F.col("_up"), "left_semi") for t in (a, b))
        a, b = (t.select("prefix", F.col("digest").alias(f"{n}_digest"), F.col("members").alias(f"{n}_members")) for t, n in ((a, "first"), (b, "second")))
        differ = a.join(b, "prefix", "full_outer").filter(~F.col("first_digest").eqNullSafe(F.col("second_digest")))
        at = cut(differ.select("prefix", F.coalesce("first_members", F.lit(0)).alias("first_members"), F.coalesce("second_members", F.lit(0)).alias("second_members")), "tree-differences")
    return at


def differing_members(leaves: DataFrame, first: DataFrame, second: DataFrame, name: str, digest: str, depth: int = DEPTH) -> DataFrame:
    """(name, first_digest, second_digest) of the members that differ, looked for in the differing leaves only."""

    def near(members: DataFrame, label: str) -> DataFrame:
        rows = members.select(F.col(name).alias("name"), F.col(digest).alias(f"{label}_digest"))
        spots = rows.withColumn("prefix", F.substring(place("name"), 1, depth))
        return spots.join(leaves.select("prefix"), "prefix", "left_semi").drop("prefix")

    joined = near(first, "first").join(near(second, "second"), "name", "full_outer")
    return joined.filter(~F.col("first_digest").eqNullSafe(F.col("second_digest"))).select("name", "first_digest", "second_digest")
