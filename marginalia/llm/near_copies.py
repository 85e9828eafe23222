"""Near copies by word shingles: SimHash trie self-join first, then an exact way for all that its budget leaves out.

The fingerprints of five-word shingles meet in simhash's trie self-join; a link it proposes counts if the sets themselves
overlap by the given per cent. Pairs that overlap by 0.8 differ in up to 22 of 64 bits, more than any Hamming budget can
deal out, so the rest is found by shingles. Sets are put in one order, common shingles last; two sets that overlap
enough share a shingle of their prefixes (n - ceil(share * n) + 1 shingles), so an equi-join of prefixes loses no pair.
The order (counts in a sample, then whether a first round of prefixes has a shingle more than once) decides only how
many candidates there are. Prefix shingles that no other text's prefix has are dropped in the scan, by a bitmap; what it
lets through meets no partner in the join. A pair is a candidate where a shared shingle lies early enough in both orders,
and is looked at closely only if counts of the sets' shingles in BUCKETS buckets allow the overlap: both are bounds that no
pair which overlaps enough can miss. Only sets of pairs that are left travel.

A shingle of very many near copies would make a pair of each two: besides the trie's, a first round therefore tries only
the text whose fingerprint is nearest to the group's majority and the neighbour in order of fingerprints; a second one
tries all pairs that the first has left in different components. A shingle of many texts is dealt over a triangle of
cells there, each of two parts of its texts, so no task gathers all of them.

Defined cases: texts of equal sets are one node; a text of fewer words than a shingle is one shingle; null and blank
texts have the empty set and stay together. Very long texts are whole: a set is one row. Only doc_id and text are read;
other columns pass through, whatever their names. Sets are told apart by XXH64 of their hashes, rows by id and text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import bitmap, forget, kept, marked, text_batches
from .components import components


BUCKETS = 256


def shingles(raw: bytes, width: int):
    """The sorted distinct hashes of a text's shingles."""
    import numpy as np
    import xxhash

    words, digest = raw.lower().split(), xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) < width:
        return np.array([digest(joined, 42)][: len(words)], np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    n = len(words) - width + 1
    spans = zip((end - length)[:n].tolist(), end[width - 1 :].tolist())
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, n))


def set_print(h) -> int:
    """The unsigned SimHash of a set of hashes."""
    import numpy as np

    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 65536):
        ones += np.unpackbits(h[k : k + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def node_of(h) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(h.tobytes())


def prefix_size(n: int, percent: int) -> int:
    return n + (-n * percent // 100) + 1 if n else 0


def common_shingles(docs: DataFrame, width: int, one_in: int, most: int):
    """Shingles that recur in a sample of texts, by hash, with their counts: so many at most."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        for batch, texts in text_batches(batches):
            sets = [shingles(x, width) for x in texts]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))], ["h"])

    drawn = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(one_in)) == 0).mapInArrow(run, "h long")
    rows = drawn.groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(most).collect()
    h = np.array([r["h"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], np.array([r["count"] for r in rows], np.int64)[order]


def prefix_of(h, often, percent: int):
    """The set's first shingles in the common order: of those that are least often there, so many that an overlap must hit one."""
    import numpy as np

    return h[np.lexsort((h, often))[: prefix_size(len(h), percent)]]


def frequency(h, common, repeated):
    """What is known of how often a shingle occurs: its count in the sample, more for those in the bitmap `repeated`."""
    import numpy as np

    known, count = common
    often = np.zeros(len(h), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        often = np.where(known[at] == h, count[at], 0)
    return often if repeated is None else often + (marked(h, repeated).astype(np.int64) << 40)


def repeated_shingles(docs: DataFrame, common, repeated, width: int, percent: int) -> DataFrame:
    """(h): shingles that several texts have in their prefixes; repeated: a bitmap that takes part in the order, or none."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for _, texts in text_batches(batches):
            sets = (shingles(x, width) for x in texts)
            h = [prefix_of(x, frequency(x, common.value, repeated.value), percent) for x in sets]
            got, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *h]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(got.view(np.int64)), pa.array(n.astype(np.int32))], ["h", "n"])

    return docs.select("text").mapInArrow(run, "h long, n int").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")


def bucket_counts(h) -> bytes:
    """How many shingles of a set fall into each bucket: a byte each, or four where a byte is too small."""
    import numpy as np

    n = np.bincount((h >> np.uint64(24)).astype(np.int64) % BUCKETS, minlength=BUCKETS)
    return n.astype("u1" if n.max() < 256 else "<u4").tobytes()


def counts_of(column):
    """An Arrow column of bucket_counts() as rows of numbers."""
    import numpy as np

    rows = column.to_pylist()
    if all(len(x) == BUCKETS for x in rows):
        return np.frombuffer(b"".join(rows), "u1").reshape(-1, BUCKETS)
    return np.stack([np.frombuffer(x, "u1" if len(x) == BUCKETS else "<u4").astype(np.uint32) for x in rows])


def may_overlap(a, b, total, percent: int):
    """Whether two sets of `total` shingles together may overlap by percent, from their counts by bucket."""
    import numpy as np

    return (100 + percent) * np.minimum(a, b).sum(axis=1, dtype=np.int64) >= percent * total


SKETCH = "node long, n long, fp long, prefix array<struct<h:long,at:long>>, buckets binary"


def sketches(docs: DataFrame, common, repeated, several, width: int, percent: int) -> DataFrame:
    """(doc_id, node, n, fp, prefix, buckets): a text's set by its hash, its size and fingerprint; those shingles of its prefix,
    with their places in the order, that are in the bitmap `several`; and, if there are any, counts of the set by bucket."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        pair = pa.struct([("h", pa.int64()), ("at", pa.int64())])
        for batch, texts in text_batches(batches):
            out: list[list] = [[], [], [], [], [], []]
            for x in texts:
                h = shingles(x, width)
                first = prefix_of(h, frequency(h, common.value, repeated.value), percent)
                at = np.flatnonzero(marked(first, several.value))
                counts = bucket_counts(h) if len(at) else None
                for column, value in zip(out, (node_of(h), len(h), set_print(h), first[at].view(np.int64), at, counts)):
                    column.append(value)
            longs = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in out[:3]]
            flat = [np.concatenate([np.zeros(0, np.int64), *c]) for c in out[3:5]]
            ends = np.r_[0, np.cumsum([len(x) for x in out[3]])].astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(c) for c in flat], fields=list(pair)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *longs, prefix, pa.array(out[5], pa.binary())], ["doc_id", "node", "n", "fp", "prefix", "buckets"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {SKETCH}")


def star_pairs(group, fp):
    """Rows (i, j) of each group, sorted by group and fp: each with the one nearest to the group's majority, and with the one before."""
    import numpy as np

    if not len(group):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[begin, len(group)])
    ones = np.zeros((len(begin), 64), np.int64)
    for bit in range(64):
        ones[:, bit] = np.add.reduceat(((fp >> np.uint64(63 - bit)) & np.uint64(1)).astype(np.int64), begin)
    major = np.packbits(2 * ones > size[:, None], axis=1).view(">u8").ravel().astype(np.uint64)
    at = np.repeat(np.arange(len(begin)), size)
    far = np.bitwise_count(fp ^ major[at])
    centre = np.lexsort((far, at))[begin][at]
    row = np.arange(len(group))
    star, before = row != centre, np.r_[False, group[1:] == group[:-1]]
    return np.r_[row[star], row[before]], np.r_[centre[star], row[before] - 1]


def all_pairs(group, label, side, n, percent: int):
    """Rows (i, j) of each group whose labels and sides differ (side -1: any), by growing distance; rows are sorted by group and
    size n, and a row is done once the next one's size is too large for an overlap of percent."""
    import numpy as np

    row = np.arange(len(group))
    for d in range(1, len(group)):
        row = row[row + d < len(group)]
        row = row[(group[row] == group[row + d]) & (percent * n[row + d] <= 100 * n[row])]
        if not len(row):
            return
        apart = row[(label[row] != label[row + d]) & ((side[row] < 0) | (side[row] != side[row + d]))]
        yield apart, apart + d


def live_nodes(nodes: DataFrame) -> DataFrame:
    """nodes with only those prefix shingles that another node's prefix has too, if there are any."""
    rows = nodes.select("node", F.explode("prefix").alias("p"))
    several = rows.groupBy("p.h").count().where("count > 1").select("h")
    own = rows.join(several, F.col("p.h") == F.col("h"), "left_semi").groupBy("node").agg(F.collect_list("p").alias("prefix"))  # of one text
    return nodes.drop("prefix").join(own, "node")


def trie_pairs(live: DataFrame, budget: int) -> DataFrame:
    """(u, v): nodes that the trie self-join of fingerprints links, nodes of one fingerprint by their least."""
    same = live.groupBy("fp").agg(F.min("node").alias("head"))
    stars = live.join(same, "fp").where("node <> head").select(F.col("node").alias("u"), F.col("head").alias("v"))
    found = simhash.links(same.select("fp"), budget)
    left, right = (same.select(F.col("fp").alias(c), F.col("head").alias(f"{c}_node")) for c in "uv")
    across = found.join(left, "u").join(right, "v").select(F.col("u_node").alias("u"), F.col("v_node").alias("v"))
    return stars.union(across).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def candidates(nodes: DataFrame, percent: int, first: bool, shard_rows: int = 200_000, hot: int = 50_000, deal: int = 1000) -> DataFrame:
    """(u, v): pairs of nodes that share a shingle of their prefixes and whose sizes allow the overlap; u > v.

    In the first round a shingle of more than `hot` nodes is dealt out at random; the second one has only shingles whose
    nodes are in several components by then, and tries all pairs across these. Its rows carry the counts by bucket, so
    that of a large group only pairs that may overlap enough come out. A shingle of more than `deal` nodes is cut into
    parts there, as many as grow with the root of its nodes: each node goes to the cells of its part with every part, so
    cells and copies of a row both grow with the root, and each two nodes meet in one cell.
    """
    own, salt = ["node", "n", "fp", "label", *([] if first else ["buckets"])], F.lit(0)
    side, total = F.lit(-1).cast("long"), nodes.agg(F.sum(F.size("prefix"))).first()[0] or 0
    rows = nodes.select(*own, F.explode("prefix").alias("p")).select(*own, "p.h", "p.at")
    sizes = rows.groupBy("h").agg(F.count("*").alias("of_h"), F.min("label").alias("low"), F.max("label").alias("high"))
    if not first:
        parts = F.when(F.col("of_h") > deal, F.ceil(4 * F.sqrt(F.col("of_h") / deal))).otherwise(1).cast("long")
        cut = kept(sizes.where("low <> high").select("h", "of_h", parts.alias("parts")), "near-cut")
        total = cut.agg(F.sum(F.col("of_h") * F.col("parts"))).first()[0] or 0
        part = F.pmod(F.xxhash64("h", "node"), F.col("parts")).alias("part")
        rows = rows.join(cut.drop("of_h"), "h").select("*", part).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        side = F.when(F.col("part") == F.col("other"), side).otherwise(F.col("part"))
        salt = F.when(F.col("parts") == 1, 0).otherwise(F.xxhash64(F.least("part", "other"), F.greatest("part", "other")))
    elif not (wide := kept(sizes.where(F.col("of_h") > hot).select("h", "of_h"), "near-hot")).isEmpty():
        rows = rows.join(wide, "h", "left")
        salt = F.coalesce(F.pmod(F.xxhash64("h", "node"), F.floor(F.col("of_h") / hot) + 1), F.lit(0))
    rows = rows.withColumn("h", F.when(salt == 0, F.col("h")).otherwise(F.xxhash64("h", salt))).select(*own, "h", "at", side.alias("side"))
    shards = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // shard_rows + 1)

    def run(table):
        import numpy as np
        import pyarrow as pa

        h, node, n, fp, label, at, side = (table.column(c).to_numpy() for c in ("h", "node", "n", "fp", "label", "at", "side"))
        fp = np.ascontiguousarray(fp).view(np.uint64)
        order = np.lexsort((fp if first else n, h))
        h = h[order]
        twin = np.r_[False, h[1:] == h[:-1]]
        twin[:-1] |= twin[1:]
        order, h = order[twin], h[twin]
        node, n, fp, label, at, side = (x[order] for x in (node, n, fp, label, at, side))
        counts = None if first or not len(order) else counts_of(table.column("buckets").take(pa.array(order)))
        found = [np.zeros((0, 2), np.int64)]
        for i, j in [star_pairs(h, fp)] if first else all_pairs(h, label, side, n, percent):
            # at the first shingle that they share, all that they share is still to come
            fit = (100 + percent) * np.minimum(n[i] - at[i], n[j] - at[j]) >= percent * (n[i] + n[j])
            i, j = i[fit], j[fit]
            if counts is not None:
                near = [may_overlap(counts[i[k : k + 20_000]], counts[j[k : k + 20_000]], (n[i] + n[j])[k : k + 20_000], percent) for k in range(0, len(i), 20_000)]
                near = np.concatenate([np.zeros(0, bool), *near])
                i, j = i[near], j[near]
            a, b = node[i], node[j]
            if len(a):
                found.append(np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table({"u": pairs[:, 0], "v": pairs[:, 1]})

    shard = F.pmod(F.xxhash64("h"), F.lit(shards)).alias("shard")
    return rows.select("*", shard).groupBy("shard").applyInArrow(run, "u long, v long").distinct()


def sets_of(docs: DataFrame, rids: DataFrame, width: int) -> DataFrame:
    """(node, own): the sets of the texts whose rid is in rids (or seems to be); docs: rid and text."""
    words = docs.sparkSession.sparkContext.broadcast(bitmap(rids))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            some = batch.filter(pa.array(marked(batch.column(0).to_numpy(), words.value)))
            for _, texts in text_batches([some]):
                sets = [shingles(x, width) for x in texts]
                node = np.array([node_of(h) for h in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))], ["node", "own"])

    return docs.select("rid", "text").mapInArrow(run, "node long, own array<long>").dropDuplicates(["node"])


def possible(pairs: DataFrame, live: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (u, v) that may overlap enough by the counts of their shingles in buckets."""
    side = lambda c: live.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("buckets").alias(f"b_{c}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "n_u", "n_v", "b_u", "b_v")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                a, b = (counts_of(batch.column(c)) for c in ("b_u", "b_v"))
                near = may_overlap(a, b, batch.column("n_u").to_numpy() + batch.column("n_v").to_numpy(), percent)
                yield batch.select(["u", "v"]).filter(pa.array(near))

    return both.mapInArrow(run, "u long, v long")


def linked(pairs: DataFrame, live: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of pairs (u, v) whose sets overlap enough; texts: rid and text."""
    pairs = kept(possible(pairs, live, percent), "near-pairs")
    asked = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(live.select("node", "first.rid"), "node")
    sets = kept(sets_of(texts, kept(asked.select("rid"), "near-asked"), width), "near-sets")
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("own").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("own").alias("b")), "v")
    same = both.select("u", "v", F.size(F.array_intersect("a", "b")).alias("same"), (F.size("a") + F.size("b")).alias("sum"))
    out = kept(same.where((100 + percent) * F.col("same") >= percent * F.col("sum")).select("u", "v"), "near-links")
    forget(pairs, sets)
    return out


def representatives(docs: DataFrame, width: int = 5, percent: int = 80, budget: int = 3, one_in: int = 16, most_common: int = 1 << 18) -> DataFrame:
    """docs with one row of each component of texts that overlap by percent: that of the least doc_id (null ids last; between repeated rows, any one)."""
    rid = F.xxhash64("doc_id", "text").alias("rid")
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), rid)
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, width, one_in, most_common))
    share = docs.sparkSession.sparkContext.broadcast
    bitmaps = [share(None)]
    for _ in range(2):  # shingles that prefixes share, first in the sample's order, then in an order that has these last
        found = kept(repeated_shingles(docs, common, bitmaps[-1], width, percent), "near-shingles")
        bitmaps.append(share(bitmap(found)))
        forget(found)
    each = kept(sketches(docs.select(own.alias("doc_id"), "text"), common, bitmaps[1], bitmaps[2], width, percent), "near-sketches")
    first = [F.min("doc_id").alias("first"), *[F.first(c).alias(c) for c in ("n", "fp", "prefix", "buckets")]]
    nodes = kept(each.groupBy("node").agg(*first), "near-nodes")
    live, texts = kept(live_nodes(nodes), "near-live"), docs.select(rid, "text")

    pairs = candidates(live.withColumn("label", F.lit(0).cast("long")), percent, True).union(trie_pairs(live, budget)).distinct()
    links = linked(pairs, live, texts, width, percent)
    labelled = live.join(components(links), "node", "left").withColumn("label", F.coalesce("root", "node"))
    more = linked(candidates(labelled, percent, False), live, texts, width, percent)
    rooted = kept(components(links.union(more)), "near-roots")
    forget(live, links, more)

    root = F.coalesce("root", "node").alias("root")
    chosen = nodes.select("node", "first").join(rooted, "node", "left").groupBy(root).agg(F.min("first").alias("least"))
    chosen = kept(chosen.select("least.id", "least.rid").distinct(), "near-chosen")
    several = not each.groupBy("doc_id").count().where("count > 1").isEmpty()
    forget(each, nodes, rooted)
    return simhash.only(docs, chosen, several)
