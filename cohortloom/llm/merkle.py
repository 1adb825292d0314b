"""Merkle manifest of a dataset: leaf hashes, one tree per group, one tree over the groups' roots.

Leaves are put in order by a range partitioning and numbered by partition totals, so a hot group is
spread over tasks. ``ARITY`` ** 2 consecutive nodes form an aligned block that keeps a level as one
string of concatenated hex digests: parents are hashes of its fixed-width substrings, the siblings of a
node are the substrings left and right of it. A block's own root is a node of the next, 256 times
smaller table, on which the same step recurses. Proofs are hashed where the block lies and are never
written out or shuffled. Everything is DataFrame expressions; no Python runs on executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.scale import checkpointed

ARITY = 16
DIGEST = 64
RUN = ARITY * DIGEST
BLOCK = ARITY * ARITY
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_hash(fields: list[Column]) -> Column:
    """Hex SHA-256 of the fields: each its byte count, a colon and its text, or a dash if null."""
    return F.sha2(F.concat(*map(_field, fields)), 256)


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos`` (from 0) in its group ``grp`` and the group's ``total``.

    Every partition of the sorted rows holds one stretch of a group; the stretches' lengths give each
    its offset, so no task sees more than its own rows and one row per stretch of a group.
    """
    by = [F.col(c).asc_nulls_first() for c in ["grp", *order]]
    dealt = checkpointed(
        rows.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
    )
    stretch = dealt.groupBy("grp", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    whole = W.partitionBy("grp")
    before = whole.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    stretch = checkpointed(
        stretch.select(
            "grp",
            "part",
            (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
            F.sum("n").over(whole).alias("total"),
        )
    )
    found = dealt.join(stretch, ["grp", "part"])
    return found.withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _parents(level: str) -> Column:
    """The level above: a hash per fixed-width substring of ``level``, concatenated."""
    return F.expr(
        f"array_join(transform(sequence(0, cast((length({level}) - 1) div {RUN} as int)),"
        f" i -> sha2(substring({level}, i * {RUN} + 1, {RUN}), 256)), '')"
    )


def _blocks(nodes: DataFrame, extra: list[str]) -> DataFrame:
    """One row per aligned block: levels ``l0`` and ``l1``, its ``node``, and ``extra`` per leaf."""
    members = F.sort_array(F.collect_list(F.struct("pos", F.col("node").alias("digest"), *extra)))
    found = nodes.groupBy("grp", F.floor(F.col("pos") / BLOCK).alias("block")).agg(
        members.alias("members"), F.first("total").alias("total")
    )
    found = found.withColumn("l0", F.expr("array_join(members.digest, '')"))
    kept = ", ".join(f"x.{c}" for c in extra) or "x.pos"
    found = found.withColumn("items", F.expr(f"transform(members, x -> struct({kept}))"))
    found = found.withColumn("l1", F.when(F.col("total") > 1, _parents("l0")))
    found = found.withColumn("l2", F.when(F.col("total") > ARITY, _parents("l1")))
    kept_columns = ["grp", "block", "total", "l0", "l1", F.coalesce("l2", "l1", "l0").alias("node")]
    return checkpointed(found.select(*kept_columns, *(["items"] if extra else [])))


def _climb(nodes: DataFrame, extra: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """All block tables from the leaves up, and (grp, node) of each group's root."""
    most = nodes.agg(F.max("total")).first()[0] or 1
    levels, roots = [], []
    while True:
        levels.append(_blocks(nodes, extra if not levels else []))
        above = levels[-1].select(
            "grp", F.col("block").alias("pos"), F.ceil(F.col("total") / BLOCK).alias("total"), "node"
        )
        roots.append(above.where("total = 1").select("grp", "node"))
        most = -(-most // BLOCK)
        if most == 1:
            return levels, reduce(DataFrame.unionByName, roots)
        nodes = above.where("total > 1")


def _flanks(level: str, index: str, width: int) -> Column:
    """Digests left and right of number ``index`` among the ``width`` of a run's string."""
    return F.expr(
        f"struct(substring({level}, 1, {index} * {DIGEST}) as before,"
        f" substring({level}, ({index} + 1) * {DIGEST} + 1, {width * DIGEST}) as after)"
    )


def _with_path(levels: list[DataFrame], top: DataFrame) -> DataFrame:
    """The lowest blocks with ``path`` (flanks of every level above the block) and the top's columns.

    ``top`` has one row per group: grp, path above the group's root, and columns handed down.
    """
    handed = [c for c in top.columns if c not in ("grp", "path")]
    above: DataFrame | None = None
    for k in range(len(levels) - 1, -1, -1):
        last = levels[k].where(F.col("total") <= BLOCK).join(top, "grp")
        if above is None:
            rows = last
        else:
            rest = levels[k].where(F.col("total") > BLOCK).join(above, ["grp", "block"])
            rows = last.unionByName(rest)
        if k:
            above = checkpointed(_children(rows, handed))
    return rows


def _runs(blocks: DataFrame, handed: list[str], items: Column) -> DataFrame:
    """One row per run of a block: its string ``run``, its flank ``own`` in ``l1``, its ``items``."""
    pieces = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(items) - 1) / ARITY).cast("int")),
        lambda r: F.slice(items, r * ARITY + 1, ARITY),
    )
    found = blocks.select(
        "grp", "block", "total", "l0", "l1", "path", *handed, F.posexplode(pieces).alias("r", "part")
    )
    own = F.when(F.col("total") > ARITY, F.array(_flanks("l1", "r", ARITY)))
    return found.select(
        "grp",
        (F.col("block") * BLOCK + F.col("r") * ARITY).alias("first"),
        "total",
        F.expr(f"substring(l0, r * {RUN} + 1, {RUN})").alias("run"),
        F.concat(F.coalesce(own, _no_path()), "path").alias("path"),
        *handed,
        "part",
    )


def _no_path() -> Column:
    return F.expr("cast(array() as array<struct<before: string, after: string>>)")


def _children(blocks: DataFrame, handed: list[str]) -> DataFrame:
    """(grp, block, path): every node of the blocks as a block of the level below."""
    slots = F.sequence(F.lit(0), F.floor(F.length("l0") / DIGEST).cast("int") - 1)
    found = _runs(blocks, handed, slots).select("*", F.posexplode("part").alias("j", "slot"))
    own = F.when(F.col("total") > 1, F.array(_flanks("run", "j", ARITY)))
    return found.select(
        "grp",
        (F.col("first") + F.col("j")).alias("block"),
        F.concat(F.coalesce(own, _no_path()), "path").alias("path"),
        *handed,
    )


def manifest(
    docs: DataFrame,
    fields: tuple[str, ...] = FIELDS,
    group: str = "source",
    order: str = "doc_id",
    changes: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: ``order``, leaf, subroot, root, proof, folded_root, verified.

    A leaf is the hash of ``fields``. Per ``group`` (null is a group of its own) leaves ascend by
    ``order``; every ``ARITY`` consecutive nodes become the hash of their digests until one is left, the
    subroot. Subroots, ordered by group (null first, bytewise), form the tree whose root is ``root``.
    ``proof_sha256`` is the hash of all siblings on the way up, ``folded_root`` what the siblings give
    for the row as ``changes`` (column -> its present value) has it, ``verified`` whether that is the root.

    Null values are leaves like any other; a null ``order`` comes first. Ties in ``order`` are broken by
    the leaf, so rows equal in all fields have equal leaves next to each other and the root depends on
    nothing else. A table of one row is its own root with an empty proof; an empty table gives no rows.
    Other columns of ``docs`` are ignored.
    """
    changes = changes or {}
    now = [changes.get(c, F.col(c)) for c in fields]
    same = reduce(
        lambda a, b: a & b, [F.col(c).eqNullSafe(v) for c, v in changes.items()], F.lit(True)
    )
    rows = docs.select(
        # null first, then bytewise; never null itself
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("grp"),
        F.col(order).cast("long").alias("id"),
        leaf_hash([F.col(c) for c in fields]).alias("node"),
        F.when(~same, leaf_hash(now)).alias("present"),
    )
    levels, subroots = _climb(_placed(rows, ["id", "node"]), ["id", "present"])

    tops = subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "node")
    top_levels, root = _climb(_placed(tops, ["name"]), ["name", "node"])
    start = root.select("grp", _no_path().alias("path"), F.col("node").alias("root"))
    of_group = _leaf_paths(_with_path(top_levels, start), ["root"]).select(
        F.col("item.name").alias("grp"), "path", F.col("item.node").alias("subroot"), "root"
    )

    # the lower part of a path differs by row, the upper part is one string and one list a block
    found = _leaf_paths(_with_path(levels, checkpointed(of_group)), ["subroot", "root"])
    present = F.coalesce("item.present", "leaf")
    return found.select(
        F.col("item.id").alias(order),
        "leaf",
        "subroot",
        "root",
        F.sha2(F.expr("array_join(transform(path, s -> concat(s.before, s.after)), '')"), 256).alias("proof_sha256"),
        F.aggregate(
            "path", present, lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256)
        ).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def _leaf_paths(blocks: DataFrame, handed: list[str]) -> DataFrame:
    """(grp, leaf, path, item): every node of the lowest blocks with its whole path."""
    found = _runs(blocks, handed, F.col("items"))
    found = found.select("*", F.posexplode("part").alias("j", "item"))
    own = F.when(F.col("total") > 1, F.array(_flanks("run", "j", ARITY)))
    return found.select(
        "grp",
        F.expr(f"substring(run, j * {DIGEST} + 1, {DIGEST})").alias("leaf"),
        F.concat(F.coalesce(own, _no_path()), "path").alias("path"),
        *handed,
        "item",
    )
