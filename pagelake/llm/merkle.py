"""Merkle manifest of a dataset, with membership proofs (operator 11).

``build`` writes a manifest to the shared folder:

* ``leaves``: one row per record, its ``tree`` (one per value of a column), its
  ``rank`` in the tree and the sha256 of its fields;
* ``records``: digest -> children digests, one row per distinct inner node of
  any tree (content-addressed: equal nodes are stored once) and its height;
* ``trees``: size, height and ``subroot`` of each tree; the subroots are the
  leaves of one more tree, whose root stands for the whole dataset.

A run of ``FAN`` consecutive nodes has one parent, the last run of a level may
be shorter; a level of one node is the root. ``prove`` starts at the root and
descends level by level: the digits of a request's rank in base ``FAN`` choose
the child, the children not chosen go into the proof, and a node that many
requests pass is looked up once. The segments come top-down and are reversed at
the leaf. ``fold`` recomputes the root from a leaf and its proof.

Ranks come from range partitions (:mod:`ordering`), so a tree that holds most
records is no task's burden; levels are grouped by eight.

Defined cases: a NULL field is ``-``; a NULL tree value is a tree of its own, the
first; records of equal id are ordered by their leaf digest, NULL ids first;
equal rows are leaves of their own; an empty table has no trees and no proofs;
a tree of one record has that leaf as its root; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, lower_ascii, shared_table
from .ordering import ranked

FAN = 8
#: Sizes of small tables of trees that are broadcast, in bytes as written.
SMALL = 4 << 20


def sha(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def field(value: Column) -> Column:
    """A field as it is hashed: ``-`` for NULL, else its UTF-8 byte count, ``:`` and it."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*fields: Column) -> Column:
    """Digest (binary) of a record's fields."""
    return sha(F.concat(*map(field, fields)))


def joined(digests: Column) -> Column:
    """Hex texts of an array of digests, concatenated."""
    return F.array_join(F.transform(digests, hexed), "")


@dataclass
class Manifest:
    leaves: DataFrame   # tree string, rank bigint, leaf binary and the columns carried
    records: DataFrame  # digest binary, height int, children array<binary>
    trees: DataFrame    # all string (the tree of subroots), tree string, n bigint, height int, subroot binary, place bigint
    root: DataFrame     # tree string, digest binary, height int: one row, or none for an empty table


def _height(n: Column, levels: int) -> Column:
    """Levels above the leaves of a tree of ``n`` records, of at most ``levels``."""
    found = F.lit(0)
    for h in range(levels):
        found = found + F.when(n > FAN**h, 1).otherwise(0)
    return found


def _levels(nodes: DataFrame, most: int, name: str) -> list[DataFrame]:
    """Inner nodes of trees over ``nodes`` (``tree``, ``idx``, ``digest``) by level:
    ``tree``, ``idx``, ``digest``, ``children``; ``most`` is the largest tree's size."""
    out: list[DataFrame] = []
    while most > 1:
        runs = nodes.groupBy("tree", F.expr(f"idx div {FAN}").alias("idx")) \
                    .agg(F.sort_array(F.collect_list(F.struct(F.col("idx").alias("i"), "digest"))).alias("run"))
        level = runs.select("tree", "idx", F.col("run.digest").alias("children"))
        level = level.select("tree", "idx", sha(joined(F.col("children"))).alias("digest"), "children")
        out.append(shared_table(level, f"{name}-{len(out) + 1}"))
        nodes, most = out[-1].select("tree", "idx", "digest"), -(-most // FAN)
    return out


def _roots(counts: DataFrame, nodes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """``counts`` (``tree``, ``n``) with each tree's ``height`` and ``subroot``."""
    counts = counts.withColumn("height", _height(F.col("n"), len(levels)))
    tops = nodes.where("idx = 0").select("tree", F.lit(0).alias("height"), F.col("digest").alias("subroot"))
    for h, level in enumerate(levels, 1):
        tops = tops.unionByName(level.where("idx = 0").select("tree", F.lit(h).alias("height"), F.col("digest").alias("subroot")))
    return counts.join(tops, ["tree", "height"])


def _records(*trees: list[DataFrame]) -> DataFrame | None:
    """``digest``, ``height``, ``children`` of the levels of some trees."""
    found = [level.select("digest", F.lit(h).alias("height"), "children") for levels in trees for h, level in enumerate(levels, 1)]
    return reduce(DataFrame.unionByName, found) if found else None


def build(table: DataFrame, fields: list[str], by: str, order: str, carry: dict[str, Column] | None = None) -> Manifest:
    """Manifest of ``table``: leaves over ``fields``, a tree per value of ``by``
    with the leaves in ascending ``order``. ``carry``: further columns of leaves."""
    f = {c: table[c] for c in fields}
    digest = leaf(*f.values())
    # '-' is less than '=': the NULL tree is the first, the others follow by their UTF-8 bytes
    tree = F.coalesce(F.concat(F.lit("="), table[by].cast("string")), F.lit("-"))
    rows = shared_table(table.select(tree.alias("tree"), table[order].alias("id"), digest.alias("leaf"),
                                     *[c.alias(k) for k, c in (carry or {}).items()]), "leaves")
    leaves = ranked(rows, "tree", ["id", "leaf"])
    counts = shared_table(rows.groupBy("tree").agg(F.count("*").alias("n")), "tree-sizes")
    most = counts.agg(F.max("n")).first()[0] or 0
    nodes = leaves.select("tree", F.col("rank").alias("idx"), F.col("leaf").alias("digest"))
    levels = _levels(nodes, most, "level")
    trees = shared_table(_roots(counts, nodes, levels).withColumn("all", F.lit("all")), "trees")
    trees = shared_table(ranked(trees, "all", ["tree"]).withColumnRenamed("rank", "place"), "placed-trees")

    tops = trees.select(F.col("all").alias("tree"), F.col("place").alias("idx"), F.col("subroot").alias("digest"))
    size = trees.groupBy(F.col("all").alias("tree")).agg(F.count("*").alias("n"))
    upper = _levels(tops, (size.first() or {"n": 0})["n"], "upper")
    root = shared_table(_roots(size, tops, upper).select("tree", F.col("subroot").alias("digest"), "height"), "root")
    inner = _records(levels, upper)
    if inner is None:  # no tree has two leaves
        inner = rows.limit(0).select(F.col("leaf").alias("digest"), F.lit(0).alias("height"), F.array("leaf").alias("children"))
    # a node of equal content stands once, at whatever height it is reached
    records = shared_table(inner.groupBy("digest", "height").agg(F.first("children").alias("children")), "records")
    return Manifest(leaves, records, trees, root)


def _descend(manifest: Manifest, start: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` (``tree``, ``rank``, ...) with ``path``, top-down: from each tree's
    ``start`` (``tree``, ``height``, ``digest``, ``path``), one level of records at a time."""
    highest = start.agg(F.max("height")).first()[0] or 0
    at_root = start.where("height = 0").select("tree", F.lit(0).cast("bigint").alias("rank"), "path")
    found = requests.join(broadcast_if_small(at_root, SMALL), ["tree", "rank"])
    reached = None
    for h in range(highest, 0, -1):
        new = start.where(F.col("height") == h).select("tree", F.lit(0).cast("bigint").alias("prefix"), "digest", "path")
        reached = new if reached is None else reached.unionByName(new)
        nodes = reached.join(manifest.records.where(F.col("height") == h).select("digest", "children"), "digest")
        others = lambda digit: F.filter("children", lambda c, i: i != digit)
        if h == 1:
            last = requests.withColumn("prefix", F.expr(f"rank div {FAN}")).join(nodes.drop("digest"), ["tree", "prefix"])
            digit = F.expr(f"cast(rank % {FAN} as int)")
            last = last.withColumn("path", F.array_append("path", F.struct(digit.alias("digit"), others(digit).alias("siblings"))))
            return found.unionByName(last.drop("prefix", "children").select(found.columns))
        wanted = requests.select("tree", F.expr(f"rank div {FAN ** (h - 1)}").alias("prefix")).distinct()
        kids = nodes.select("tree", "prefix", "path", "children", F.posexplode("children").alias("digit", "child"))
        reached = kids.select("tree", (F.col("prefix") * FAN + F.col("digit")).alias("prefix"), F.col("child").alias("digest"),
                              F.array_append("path", F.struct("digit", others(F.col("digit")).alias("siblings"))).alias("path")) \
                      .join(wanted, ["tree", "prefix"], "left_semi")
    return found


PATH = "array<struct<digit:int,siblings:array<binary>>>"


def prove(manifest: Manifest, requests: DataFrame) -> DataFrame:
    """``requests`` (``tree``, ``rank`` and any others) with ``path`` (from the leaf
    to the root: the place among its run and the run's other digests, in order),
    ``subroot`` and ``root``. Requests of no leaf give no row."""
    top = manifest.root.select("tree", "height", "digest", F.lit([]).cast(PATH).alias("path"))
    asked = manifest.trees.select(F.col("all").alias("tree"), F.col("place").alias("rank"), F.col("tree").alias("name"), "height", "subroot")
    trees = shared_table(_descend(manifest, top, asked).select(F.col("name").alias("tree"), "height", F.col("subroot").alias("digest"), "path"), "tree-paths")
    found = _descend(manifest, trees, requests).withColumn("path", F.reverse("path"))
    root = manifest.root.first()  # one digest, or none
    roots = shared_table(manifest.trees.select("tree", "subroot", F.lit(bytes(root["digest"]) if root else None).cast("binary").alias("root")), "roots")
    return found.join(broadcast_if_small(roots, SMALL), "tree")


def fold(leaf_digest: Column, path: Column) -> Column:
    """Root (hex) that a leaf and its proof give."""

    def up(below, s):
        return F.sha2(F.concat(joined(F.slice(s["siblings"], F.lit(1), s["digit"])), below,
                               joined(F.slice(s["siblings"], s["digit"] + 1, F.lit(FAN)))), 256)

    return F.aggregate(path, hexed(leaf_digest), up)


def digests(docs: DataFrame) -> DataFrame:
    """Manifest and proofs of ``documents`` in trees by ``lang``; for a third of
    them the root is recomputed from a leaf with lower-cased text."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    changed = leaf(*[lower_ascii(docs[c]) if c == "text" else docs[c] for c in fields])
    tampered = F.coalesce(F.crc32(docs["doc_id"].cast("string")) % 3 == 0, F.lit(False))
    m = build(docs, fields, by="lang", order="doc_id", carry={"changed": F.when(tampered, changed)})
    proofs = prove(m, m.leaves.select("tree", "rank", "id", "leaf", "changed"))
    proofs = proofs.select(F.col("id").alias("doc_id"), hexed(F.col("leaf")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"),
                           hexed(F.col("root")).alias("root"), F.sha2(joined(F.flatten("path.siblings")), 256).alias("proof_sha256"),
                           fold(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"))
    return proofs.withColumn("verified", F.col("folded_root") == F.col("root"))
