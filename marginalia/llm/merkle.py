"""Merkle manifest of a dataset by nested-interval labels: every node carries the interval of leaf ranks that it covers.

Leaves are ranked within their group by key: a range partition by (group, key), then ranks from the sums of partitions,
so a group of any size is dealt over many tasks. `fan` consecutive nodes become their parent, until one node is left. A
node's interval says where it belongs: at a level, buckets of fan ** level ranks hold one node each, so a containment
join of a child's interval with its ancestor's is an equi-join by bucket. `LAYER` levels are one step: a row holds all
nodes within one bucket of fan ** LAYER nodes, with their intervals, so a forest of n leaves takes log n / log 729 jobs.
Going down, each bucket meets the bucket of the layer above that contains it and takes over the way from there to the
root. A node's siblings are the parent's interval less its own: what ends before it on the left, what begins after it on
the right. The roots of the groups, ordered by group, are the leaves of one more tree of the same kind.

Digests are computed in the scan; texts are never shuffled. Each join is by (group, bucket), of which a group of a third
of all rows has as many as its size needs.

Defined cases: a null column counts as `-`, a null source is a group of its own, the first; a null doc_id comes before
all others and is never tampered with; equal doc_ids are ordered by their leaves, so repeated rows are leaves of their
own, equal in all columns but the proof; a group of one leaf is its own root; a very long text is hashed whole; an empty
table gives an empty one. Only doc_id, source, lang, n_chars and text are read, whatever other columns there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, kept, let

FAN = 3
#: Levels that one row of nodes spans: 3 ** 6 = 729 leaves.
LAYER = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(*values: Column) -> Column:
    """The digest of values, each its length in bytes and itself, or `-` for null."""
    texts = [v.cast("string") for v in values]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def tampered(doc_id: Column, text: Column) -> Column:
    """text without its line ends where 2 divides crc32(doc_id)."""
    return F.when(F.crc32(doc_id.cast("string")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def ranked(leaves: DataFrame) -> DataFrame:
    """leaves (group, key, digest, ...) with `lo`, the rank within the group by key, then digest, and `many`, the group's size.

    The rows are sorted once; of each partition's groups two numbers are summed and joined back.
    """
    order = ["group", F.col("key").asc_nulls_first(), "digest"]
    placed = leaves.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = kept(placed.withColumn("part", F.shiftright("at", 33)), "merkle-leaves")
    counts = placed.groupBy("group", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    own = Window.partitionBy("group")  # of a row for each partition of the sort at most
    before = F.coalesce(F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select(F.col("group").alias("g"), F.col("part").alias("p"), (before - F.col("first")).alias("shift"), F.sum("n").over(own).alias("many"))
    met = placed.join(shifts, F.col("group").eqNullSafe(F.col("g")) & (F.col("part") == F.col("p")))
    return met.withColumn("lo", F.col("at") + F.col("shift")).drop("at", "part", "g", "p", "shift")


def _parents(level: Column) -> Column:
    """The nodes above a level, each of `FAN` consecutive ones: the first one's lo, the last one's hi, the digest of digests."""

    def parent(i):
        return let(F.slice(level, FAN * i + 1, F.lit(FAN)), lambda run: F.struct(run[0]["lo"].alias("lo"), F.element_at(run, -1)["hi"].alias("hi"), F.sha2(F.array_join(F.transform(run, lambda x: x["digest"]), ""), 256).alias("digest")))

    return F.transform(F.sequence(F.lit(0), F.floor((F.size(level) + FAN - 1) / FAN).cast("int") - 1), parent)


def _levels(nodes: Column, top: Column) -> Column:
    """nodes and the levels above them: `LAYER` of them, or in a top bucket until one node is left."""
    grow = lambda acc, _: let(F.element_at(acc, -1), lambda last: F.when(top & (F.size(last) == 1), acc).otherwise(F.concat(acc, F.array(_parents(last)))))
    return F.aggregate(F.sequence(F.lit(1), F.lit(LAYER)), F.array(nodes), grow)


def build(leaves: DataFrame) -> list[DataFrame]:
    """The layers of the groups' trees, the lowest first: a row for each bucket with its group, number, items and levels of nodes.

    leaves: group, key, digest, load; load goes with the leaf. A node is (lo, hi, digest): the ranks it covers are lo to hi - 1.
    """
    nodes = ranked(leaves).select("group", "many", F.struct("lo", (F.col("lo") + 1).alias("hi"), "digest", "load").alias("item"))
    layers, width = [], 1
    while True:
        below, width = width, width * FAN**LAYER
        buckets = nodes.groupBy("group", F.floor(F.col("item.lo") / width).alias("bucket")).agg(
            F.max("many").alias("many"), F.array_sort(F.collect_list("item")).alias("items")  # FAN ** LAYER at most
        )
        plain = F.transform("items", lambda x: F.struct(x["lo"], x["hi"], x["digest"]))
        top = (F.col("many") <= width).alias("top")
        layer = kept(buckets.select("*", top, F.lit(below).cast("long").alias("unit"), _levels(plain, F.col("many") <= width).alias("levels")), "merkle-layer")
        layers.append(layer)
        if layer.where("not top").isEmpty():
            return layers
        crown = F.element_at(F.element_at("levels", -1), 1)
        nodes = layer.where("not top").select("group", "many", F.struct(crown["lo"].alias("lo"), crown["hi"].alias("hi"), crown["digest"].alias("digest"), F.lit(0).alias("load")).alias("item"))


def _steps(lo: Column) -> Column:
    """What stands beside the node that holds rank lo, level by level within its bucket: the digests on its left and right, joined."""

    def step(k):
        # The parent's interval is a bucket of ranks; less the node's own interval it leaves what ends before lo and what begins after.
        own = F.col("unit") * F.pow(F.lit(FAN), k - 1).cast("long")
        at = F.floor((lo - F.col("items")[0]["lo"]) / (own * FAN)).cast("int")

        def sides(run):
            left = F.filter(run, lambda x: x["hi"] <= lo)
            right = F.filter(run, lambda x: x["lo"] > lo)
            return F.struct(*[F.array_join(F.transform(side, lambda x: x["digest"]), "").alias(name) for name, side in (("left", left), ("right", right))])

        return let(F.slice(F.element_at("levels", k), at * FAN + 1, F.lit(FAN)), sides)

    return F.when(F.size("levels") > 1, F.transform(F.sequence(F.lit(1), F.size("levels") - 1), step)).otherwise(F.array().cast(STEPS))


STEPS = "array<struct<left: string, right: string>>"


def roots(layers: list[DataFrame]) -> DataFrame:
    """(group, digest): the root of each group's tree."""
    found = [x.where("top").select("group", F.element_at(F.element_at("levels", -1), 1)["digest"].alias("digest")) for x in layers]
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def ways(layers: list[DataFrame], outer: DataFrame | None = None) -> DataFrame:
    """(group, load, digest, way, root) for each leaf: way holds the siblings of it and its ancestors, level by level.

    outer: (group, way, root), where a group's root goes on from; without it, the way ends at the group's root.
    """
    if outer is None:
        outer = roots(layers).select("group", F.array().cast(STEPS).alias("way"), F.col("digest").alias("root"))
    outer = outer.select(F.col("group").alias("g"), F.col("way").alias("up"), "root")
    begun = None
    for k in range(len(layers) - 1, -1, -1):
        layer, ours = layers[k], F.col("group").eqNullSafe(F.col("g"))
        crowned = layer.where("top").join(outer, ours)
        if begun is not None:  # the bucket above that contains this one's interval
            crowned = crowned.unionByName(layer.where("not top").join(begun, ours & (F.col("bucket") == F.col("b"))).select(crowned.columns))
        if k == 0:
            item = lambda x: F.struct(x["load"].alias("load"), x["digest"].alias("digest"), F.concat(_steps(x["lo"]), "up").alias("way"))
            return crowned.select("group", "root", F.inline(F.transform("items", item))).select("group", "load", "digest", "way", "root")
        inner = FAN ** (LAYER * k)
        item = lambda x: F.struct(F.floor(x["lo"] / inner).alias("b"), F.concat(_steps(x["lo"]), "up").alias("up"))  # noqa: E731,B023
        begun = kept(crowned.select(F.col("group").alias("g"), "root", F.inline(F.transform("items", item))), "merkle-ways")


def proof(way: Column) -> Column:
    return F.sha2(F.array_join(F.transform(way, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def folded(digest: Column, way: Column) -> Column:
    """The root that a leaf of that digest has with the siblings of way."""
    return F.aggregate(way, digest, lambda acc, x: F.sha2(F.concat(x["left"], acc, x["right"]), 256))


def _leaves(docs: DataFrame) -> DataFrame:
    own = leaf(*[F.col(c) for c in FIELDS])
    changed = tampered(F.col("doc_id"), F.col("text"))
    again = F.when(changed.eqNullSafe(F.col("text")), F.lit(None)).otherwise(leaf(*[changed if c == "text" else F.col(c) for c in FIELDS]))
    rows = docs.select(F.col("source").alias("group"), F.col("doc_id").alias("key"), own.alias("digest"), again.alias("load"))
    return kept(rows, "merkle-digests")


def nodes(docs: DataFrame) -> DataFrame:
    """The manifest: (source, level, lo, hi, digest) of every node of every source's tree; [lo, hi) are the leaf ranks it covers."""
    digests = _leaves(docs)
    out = None
    for k, layer in enumerate(build(digests)):
        rows = layer.select(F.col("group").alias("source"), F.posexplode("levels").alias("at", "level_nodes"))
        if k:
            rows = rows.where("at > 0")  # the lowest level of a layer is the highest of the one below
        rows = rows.select("source", (F.col("at") + LAYER * k).cast("long").alias("level"), F.inline("level_nodes"))
        out = rows if out is None else out.union(rows)
    forget(digests)
    return out


def proofs(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, way (siblings by level, left and right), and the leaf as tampered() leaves it, of every row."""
    digests = _leaves(docs)
    trees = build(digests.select("group", "key", "digest", F.struct("key", "load").alias("load")))
    forget(digests)
    subroots = kept(roots(trees), "merkle-subroots")
    crown = build(subroots.select(F.lit(0).alias("group"), F.col("group").alias("key"), "digest", F.struct("group").alias("load")))
    above = kept(ways(crown).select(F.col("load.group").alias("group"), F.col("digest").alias("subroot"), "way", "root"), "merkle-above")
    outer = above.select("group", "way", F.struct("subroot", "root").alias("root"))
    found = ways(trees, outer)
    return found.select(
        F.col("load.key").alias("doc_id"), F.col("digest").alias("leaf"), "root.subroot", "root.root", "way", F.coalesce("load.load", "digest").alias("tampered_leaf")
    )
