"""Merkle manifest of a dataset, with nested-interval labels on its nodes.

The rows of a group are its leaves, ranked in order.  A node covers an interval ``[lo, hi)`` of leaf ranks; a node of level
``k`` lies in the bucket ``lo div fanout^(k+1)`` of the level above.  Ancestors are attached by joins of neighbouring levels
on that bucket with the containment of intervals as condition, from the roots down, so each join has at most ``fanout`` rows
of a key on one side and one on the other, however large a group is.  The siblings of a node are what is left of its parent's
interval without its own: the children to the left of ``lo`` and those from ``hi`` on.  The group's roots are themselves the
leaves of one more tree, whose paths enter at the top of the downward joins.

Ranks come from a range partitioning, so a group with a third of all rows spreads over many tasks; only digests move, never
texts.  Levels are checkpointed: a lost executor costs no recomputation, and each level is an eighth of the one below.

Odd rows: a null field counts as ``-``; null groups are a group of their own, before all others; rows without order value come
first; equal order values follow their leaf's digest, and repeated rows are leaves each (interchangeable ones).  An empty
table has no rows, no nodes and no root.  Other columns of the input, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberflow.operators.positions import with_position
from timberflow.session import materialize

#: Children of a node, and the fields that make a leaf, in the order in which they are hashed.
FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest_of(digests: Column) -> Column:
    """Binary sha256 of concatenated binary digests, which are hashed as lowercase hex text."""
    return F.unhex(F.sha2(F.lower(F.hex(digests)), 256))


def encoded(value: Column) -> Column:
    """A field as it is hashed: ``-`` if null, else its UTF-8 byte count, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*(encoded(v) for v in values)), 256))


def lower_ascii(text: Column) -> Column:
    """Only A-Z lower-cased; a text of single-byte characters can take the plain function."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def _group_key(value: Column) -> Column:
    """Text that is never null and sorts as the value does, null first."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def ranked(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """Leaves (``grp``, ``digest``, more) with the interval ``[lo, hi)`` of their rank in the group.

    Rows that agree in all of the order are interchangeable; a random last key spreads a crowd of them.
    """
    salted = leaves.withColumn("_salt", F.rand(11))
    placed = with_position(salted, [*order, "digest", "_salt"], ["grp"], "hi")
    return placed.withColumn("lo", F.col("hi") - 1).drop("_salt")


def bucket(level: int, fanout: int) -> Column:
    """Bucket of a node of ``level`` among the nodes of the level above."""
    return F.floor(F.col("lo") / F.lit(fanout ** (level + 1))).cast("long")


def build(leaves: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels from the leaves up: each has ``grp``, ``lo``, ``hi``, ``digest``, and above the leaves ``children``.

    A group whose first bucket would get a single child consists of that one node, so it has no node on the next level.
    """
    levels = [leaves]
    tallest = leaves.agg(F.max("hi")).first()[0] or 0
    while fanout ** (len(levels) - 1) < tallest:
        below = levels[-1].select("grp", bucket(len(levels) - 1, fanout).alias("bucket"), F.struct("lo", "hi", "digest").alias("node"))
        runs = below.groupBy("grp", "bucket").agg(F.sort_array(F.collect_list("node")).alias("children"))
        runs = runs.filter((F.col("bucket") > 0) | (F.size("children") > 1))
        digests = F.aggregate("children", F.unhex(F.lit("")), lambda all_, child: F.concat(all_, child["digest"]))
        level = runs.select("grp", F.col("children")[0]["lo"].alias("lo"), F.element_at("children", -1)["hi"].alias("hi"), digest_of(digests).alias("digest"), "children")
        levels.append(materialize(level))
    return levels


def tops(levels: Sequence[DataFrame]) -> DataFrame:
    """The root of each group with its level: the node at rank 0 that has none above it."""
    found = None
    for k, level in enumerate(levels):
        first = level.filter("lo = 0").select("grp", F.lit(k).alias("level"), "lo", "hi", "digest")
        if k + 1 < len(levels):
            first = first.join(levels[k + 1].filter("lo = 0").select("grp"), "grp", "left_anti")
        found = first if found is None else found.unionByName(first)
    return materialize(found)


def attach(levels: Sequence[DataFrame], roots: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Leaves with ``up``: what ``roots`` say of their group (a struct with ``steps``), the leaf's own steps put in front.

    A step holds the digests of the siblings to the left and to the right, as concatenated binary values.  A root's context
    is the root itself, which adds no step.
    """
    above = None
    for k in reversed(range(len(levels))):
        own = roots.filter(F.col("level") == k)
        none = F.lit(None).cast("array<struct<lo:bigint,hi:bigint,digest:binary>>")
        context = own.select("grp", F.lit(0).cast("long").alias("bucket"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"), none.alias("p_children"), "up")
        if above is not None:
            parents = above.select("grp", bucket(k, fanout).alias("bucket"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"), F.col("children").alias("p_children"), "up")
            context = parents.unionByName(context)
        inside = (F.col("p_lo") <= F.col("lo")) & (F.col("hi") <= F.col("p_hi"))
        nodes = levels[k].withColumn("bucket", bucket(k, fanout)).join(context, ["grp", "bucket"]).filter(inside)
        join = lambda keep: F.aggregate(F.filter("p_children", keep), F.unhex(F.lit("")), lambda all_, child: F.concat(all_, child["digest"]))
        step = F.struct(
            join(lambda child: child["hi"] <= F.col("lo")).alias("left"),
            join(lambda child: child["lo"] >= F.col("hi")).alias("right"),
        )
        steps = F.when(F.col("p_children").isNull(), F.col("up.steps")).otherwise(F.concat(F.array(step), F.col("up.steps")))
        above = nodes.withColumn("up", F.struct("up.subroot", "up.root", steps.alias("steps"))).drop("bucket", "p_lo", "p_hi", "p_children")
    return above


def forest(leaves: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Leaves with ``up``: subroot of their group, root of all, and the steps from the leaf to that root."""
    levels = build(leaves, fanout)
    subroots = tops(levels)
    blank = F.array().cast("array<struct<left:binary,right:binary>>")
    heads = ranked(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("member"), "digest"), ["member"])
    upper = build(heads, fanout)
    crown = tops(upper).withColumn("up", F.struct(F.lit(None).cast("binary").alias("subroot"), F.col("digest").alias("root"), blank.alias("steps")))
    paths = attach(upper, crown, fanout).select(F.col("member").alias("grp"), F.struct(F.col("digest").alias("subroot"), "up.root", "up.steps").alias("up"))
    return attach(levels, subroots.join(paths, "grp"), fanout)


def folded(digest: Column, steps: Column) -> Column:
    """The root that a leaf's digest and its siblings give."""
    return F.aggregate(steps, digest, lambda at, step: digest_of(F.concat(step["left"], at, step["right"])))


def proof_digest(steps: Column) -> Column:
    """Hex sha256 of all sibling digests, level by level from the leaf up, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda step: F.lower(F.hex(F.concat(step["left"], step["right"])))), ""), 256)


def leaves_of(documents: DataFrame, changed: dict[str, Column] | None = None, when: Column | None = None) -> DataFrame:
    """Leaves (``grp``, ``doc_id``, ``digest``) and ``presented``: the digest with ``changed`` fields in rows where ``when`` holds."""
    values = {name: F.col(name) for name in FIELDS}
    digest = leaf_digest(list(values.values()))
    presented = digest if when is None else F.when(when, leaf_digest(list((values | (changed or {})).values()))).otherwise(F.lit(None))
    return documents.select(_group_key(F.col("lang")).alias("grp"), "doc_id", digest.alias("digest"), presented.alias("presented"))


def manifest(documents: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """All nodes of the groups' trees: (``grp``, ``level``, ``lo``, ``hi``, ``digest`` as hex); the group key is ``=`` and lang, or empty for null."""
    levels = build(ranked(leaves_of(documents).select("grp", "doc_id", "digest"), ["doc_id"]), fanout)
    nodes = [level.select("grp", F.lit(k).alias("level"), "lo", "hi", F.lower(F.hex("digest")).alias("digest")) for k, level in enumerate(levels)]
    out = nodes[0]
    for level in nodes[1:]:
        out = out.unionByName(level)
    return out


def verify(documents: DataFrame, changed: dict[str, Column] | None = None, when: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """One row per document: its leaf, subroot, root, proof, and the root that the presented document folds to.

    ``changed`` gives the fields as they are presented in the rows where ``when`` is true; siblings are always the manifest's.
    A null ``when`` counts as false.
    """
    placed = ranked(leaves_of(documents, changed, when), ["doc_id"])
    proven = forest(placed, fanout).withColumn("folded", folded(F.coalesce("presented", "digest"), F.col("up.steps")))
    text = lambda value: F.lower(F.hex(value))
    return proven.select(
        "doc_id",
        text(F.col("digest")).alias("leaf"),
        text(F.col("up.subroot")).alias("subroot"),
        text(F.col("up.root")).alias("root"),
        proof_digest(F.col("up.steps")).alias("proof_sha256"),
        text(F.col("folded")).alias("folded_root"),
        (F.col("folded") == F.col("up.root")).alias("verified"),
    )


def tampered(documents: DataFrame, part: int = 3) -> DataFrame:
    """:func:`verify` where every document whose crc32 of the id's decimal text is divisible by ``part`` has its A-Z lower-cased."""
    return verify(documents, {"text": lower_ascii(F.col("text"))}, F.crc32(F.col("doc_id").cast("string")) % part == 0)
