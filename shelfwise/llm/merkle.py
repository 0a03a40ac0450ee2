"""Merkle manifest of a table: leaves, one tree per group, one tree over the groups.

A leaf is the hash of a row's fields, each with its length. Leaves of a group
stand in order; a run of ``arity`` consecutive nodes becomes the hash of their
digests, the last run of a level may be shorter, even a single node, and a level
of one node is the group's root. The group roots, in the order of the groups,
give the root of all in the same way.

Every level is one equijoin with itself for each shift of the slot: a node meets
its sibling at the computed index, index XOR 1 for binary trees, the index of
the shifted slot of its run otherwise. Nodes of slot zero hold their whole run
and emit the parents. What a node found is written and read again on the way
down, where every child takes its parent's path and puts its own siblings
before it. So a level costs as much as it has nodes, no group is ever in one
task, and texts are hashed where they are read and never moved.

Positions come from a global sort of (group, order, digest); equal rows are
leaves of their own. Any column may be null. Null groups and null order values
come first. Very long texts are hashed as a whole. Columns that are not named
are not read, so their names cannot clash. An empty table has no root and gives
an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.ordered import global_rank
from shelfwise.sources.storage import written

# Nodes of a level, and bytes of the paths of a level, that are broadcast at most; more are joined by shuffle.
BROADCAST_NODES = 100_000
BROADCAST_BYTES = 8 << 20
_PATH = "array<struct<left: binary, right: binary>>"


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts' concatenation, 32 bytes."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def hexed(c: Column | str) -> Column:
    return F.lower(F.hex(c))


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(*[field(v) for v in values])


@dataclass(frozen=True)
class Manifest:
    """Written leaves with their paths, and the root (lower-case hex; None for an empty table).

    ``leaves``: the carried columns, leaf, subroot (binary), path: per level the
    digests of the run's other nodes before and after, from the leaf to the root.
    """

    leaves: DataFrame
    root: str | None


def _with_siblings(nodes: DataFrame, arity: int, rows: int) -> DataFrame:
    """Nodes (g, i, c, h) with left and right: the digests of the others of their run."""
    slot = F.pmod("i", F.lit(arity))
    met = nodes
    for shift in range(1, arity):
        at = F.col("i").bitwiseXOR(F.lit(1).cast("long")) if arity == 2 else F.col("i") - slot + F.pmod(slot + shift, F.lit(arity))
        other = nodes.select(F.col("g").alias("_g"), F.col("i").alias("_i"), F.col("h").alias(f"h{shift}"))
        other = F.broadcast(other) if rows <= BROADCAST_NODES else other
        met = met.join(other, (met["g"] == F.col("_g")) & (at == F.col("_i")), "left").drop("_g", "_i")
    # The sibling of shift s stands before the node where its slot wraps around.
    none = F.lit(b"")
    wraps = lambda s: slot + s >= arity
    left = [F.when(wraps(s), F.coalesce(f"h{s}", none)).otherwise(none) for s in range(1, arity)]
    right = [F.when(~wraps(s), F.coalesce(f"h{s}", none)).otherwise(none) for s in range(1, arity)]
    together = lambda xs: F.concat(*xs) if xs else none
    return met.select("g", "i", "c", "h", together(left).alias("left"), together(right).alias("right"))


def _parents(met: DataFrame, arity: int) -> DataFrame:
    zero = met.filter(F.pmod("i", F.lit(arity)) == 0)
    return zero.select(
        "g", F.expr(f"i div {arity}").alias("i"), F.ceil(F.col("c") / arity).cast("long").alias("c"),
        digest(hexed("h"), hexed("right")).alias("h"))


def _bound(rows: int, groups: int, arity: int, level: int) -> int:
    """No fewer nodes than a level has."""
    return rows // arity ** level + groups


def _packed(df: DataFrame, rows: int) -> DataFrame:
    """Tasks of 16,384 rows or so for a level that was not shuffled."""
    return df.coalesce(1 + rows // 16_384)


def _up(nodes: DataFrame, arity: int, rows: int, groups: int, longest: int) -> tuple[list[DataFrame], DataFrame]:
    """The levels of all groups with their siblings, and the roots (g, h)."""
    levels, roots, level = [], [], 0
    while True:
        roots.append(nodes.filter("c = 1").select("g", "h"))
        if longest <= 1:
            break
        few = _bound(rows, groups, arity, level)
        met = _with_siblings(nodes.filter("c > 1"), arity, few)
        met = written(_packed(met, few) if few <= BROADCAST_NODES else met, "level")
        levels.append(met)
        nodes = _parents(met, arity)
        longest, level = -(-longest // arity), level + 1
    together = roots[0]
    for r in roots[1:]:
        together = together.unionByName(r)
    return levels, written(together, "roots")


def _down(levels: list[DataFrame], roots: DataFrame, arity: int, rows: int, groups: int, depth: int) -> DataFrame:
    """Paths (g, i, path, subroot) of the nodes of the lowest level; ``roots`` holds (g, path, subroot)."""
    tops = roots.select("g", F.lit(0).cast("long").alias("i"), F.lit(1).cast("long").alias("c"), "path", "subroot")
    paths = tops
    for level in range(len(levels) - 1, -1, -1):
        met = levels[level]
        above = paths.select(F.col("g").alias("_g"), F.col("i").alias("_i"), "path", "subroot")
        # A group whose root is the parent joins it here, one whose root lies higher its parent's path.
        size = _bound(rows, groups, arity, level + 1) * (depth + len(levels) - level) * 80
        above = F.broadcast(above) if size <= BROADCAST_BYTES else above
        own = F.array(F.struct("left", "right"))
        met = met.join(above, (met["g"] == F.col("_g")) & (F.expr(f"i div {arity}") == F.col("_i")))
        paths = met.select("g", "i", "c", F.concat(own, "path").cast(_PATH).alias("path"), "subroot")
        paths = written(_packed(paths, _bound(rows, groups, arity, level)) if size <= BROADCAST_BYTES else paths, "paths")
        # Groups of one node at this level had no run here; their path is that of their root.
        paths = paths.unionByName(_single(tops, levels, level))
    return paths


def _single(tops: DataFrame, levels: list[DataFrame], level: int) -> DataFrame:
    """Roots of groups that are a single node at ``level`` and have no run there."""
    inside = levels[level].filter("i = 0").select("g")
    return tops.join(inside, "g", "left_anti")


def build(rows: DataFrame, group: Column, order: Column, value: Column, carry: list[str], arity: int = 2) -> Manifest:
    """The manifest of ``rows``: leaves ``value`` (binary) by ``order`` within ``group``, with the columns ``carry``."""
    if arity < 2:
        raise ValueError("a run holds two nodes at least")
    kept = [F.col(c).alias(f"c_{c}") for c in carry]
    named = written(rows.select(group.alias("_group"), order.alias("_order"), value.alias("_leaf"), *kept), "leaves")
    sort = [F.col("_group").asc_nulls_first(), F.col("_order").asc_nulls_first(), F.col("_leaf")]
    tied = named.withColumn("_tie", F.monotonically_increasing_id())  # equal rows spread over partitions
    placed = global_rank(tied, [*sort, F.col("_tie")], "_at")
    sizes = written(placed.groupBy("_group").agg(F.min("_at").alias("g"), F.count(F.lit(1)).alias("c")), "groups")
    n, groups, longest = sizes.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.max("c"), F.lit(0))).first()
    back = [F.col(f"c_{c}").alias(c) for c in carry]
    if not n:
        return Manifest(named.select(*back, F.col("_leaf").alias("leaf"), F.lit(b"").alias("subroot"), F.array().cast(_PATH).alias("path")), None)
    group_rows = sizes.select(F.col("_group").alias("_of"), "g", "c")
    group_rows = F.broadcast(group_rows) if groups <= BROADCAST_NODES else group_rows
    # A group is named by the place of its first leaf, so names are in the order of the groups.
    leaves = placed.join(group_rows, F.col("_group").eqNullSafe(F.col("_of"))).withColumn("i", F.col("_at") - F.col("g"))
    leaves = written(leaves.select("g", "i", "c", F.col("_leaf").alias("h"), *[f"c_{c}" for c in carry]), "placed")
    levels, subroots = _up(leaves.select("g", "i", "c", "h"), arity, n, groups, longest)

    ranked = global_rank(subroots.select(F.col("g").alias("s"), "h"), [F.col("s")], "_at")
    tops = written(ranked.select(
        F.lit(0).cast("long").alias("g"), (F.col("_at") - 1).alias("i"), F.lit(groups).cast("long").alias("c"), "h", "s"), "tops")
    top_levels, top = _up(tops.drop("s"), arity, groups, 1, groups)
    root = top.select(hexed("h")).first()[0]
    start = top.select("g", F.array().cast(_PATH).alias("path"), F.lit(b"").alias("subroot"))
    top_paths = _down(top_levels, start, arity, groups, 1, 0)
    of_group = tops.join(top_paths.select("g", "i", "path"), ["g", "i"]).select(
        F.col("s").alias("g"), "path", F.col("h").alias("subroot"))
    of_group = written(of_group, "subroots")

    paths = _down(levels, of_group, arity, n, groups, len(top_levels))
    found = leaves.join(paths.select("g", "i", "path", "subroot"), ["g", "i"])
    return Manifest(found.select(*back, F.col("h").alias("leaf"), "subroot", "path"), root)


def proof(path: str = "path") -> Column:
    """The siblings' digests from the leaf to the root, as hex text."""
    return F.array_join(F.transform(path, lambda p: F.concat(hexed(p["left"]), hexed(p["right"]))), "")


def folded(value: Column, path: str = "path") -> Column:
    """The root that a leaf (binary) and its path give, as hex text."""
    step = lambda h, p: F.sha2(F.concat(hexed(p["left"]), h, hexed(p["right"])), 256)
    return F.aggregate(path, hexed(value), step)
