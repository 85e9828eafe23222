"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by a binary trie self-join.

Two fingerprints within `budget` differing bits agree on one of budget + 1 blocks of bits, so each distinct fingerprint
goes to one group for each block. Within a group the fingerprints form a binary trie, and pairs of its nodes are
traversed together from the root: each step down splits both nodes by the next bit, the differing bits add up, and a
pair is dropped when they exceed the budget. Groups over `group_limit` fingerprints are dealt again by a block of the
bits that are left, so no group grows with the corpus and no link is lost. Exact copies share a fingerprint and are one
node from the start.

Defined cases: null or blank text has fingerprint 0 and is linked like any other. A text of fewer words than a shingle
is one shingle; very long texts are hashed whole, 65,536 shingles at a time. A null doc_id never names a component; a component of null ids alone has a null component_id. Repeated
rows come out once each. Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, kept, text_batches
from .components import components


def fingerprint(raw: bytes, width: int = 3) -> int:
    """The unsigned SimHash of a text's shingles, repeats included, hashed by XXH64 with seed 42."""
    import numpy as np
    import xxhash

    words = raw.lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < width:
        return digest(joined, 42)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    begin = end - length
    n = len(words) - width + 1
    ones = np.zeros(64, np.int64)
    spans = list(zip(begin[:n].tolist(), end[width - 1 :].tolist()))
    for k in range(0, n, 65536):
        h = np.array([digest(joined[a:b], 42) for a, b in spans[k : k + 65536]], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch, texts in text_batches(batches):
            fp = np.array([fingerprint(x, width) for x in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(fp)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, fp long")


def trie_links(key, fp, budget: int):
    """Index pairs (i, j) of one key whose fingerprints differ in at most budget bits; fingerprints of a key are distinct."""
    import numpy as np

    order = np.lexsort((fp, key))
    k, f = key[order], fp[order]
    starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    ends = np.r_[starts[1:], len(k)]
    wide = ends - starts > 1
    alo = blo = starts[wide]
    ahi = bhi = ends[wide]
    err = np.zeros(len(alo), np.int8)
    left, right = [], []
    for bit in range(63, -1, -1):
        if not len(alo):
            break
        ones = np.r_[0, np.cumsum((f >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)]
        amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
        same = alo == blo
        parts = []
        for a_one, b_one in ((0, 0), (1, 1), (0, 1), (1, 0)):
            use = ~same if (a_one, b_one) == (1, 0) else slice(None)
            part = (
                (amid if a_one else alo)[use], (ahi if a_one else amid)[use],
                (bmid if b_one else blo)[use], (bhi if b_one else bmid)[use],
                (err + np.int8(a_one != b_one))[use],
            )
            live = (part[0] < part[1]) & (part[2] < part[3]) & (part[4] <= budget) & ((part[0] != part[2]) | (part[1] - part[0] > 1))
            parts.append(tuple(x[live] for x in part))
        alo, ahi, blo, bhi, err = (np.concatenate(x) for x in zip(*parts))
        lone = (ahi - alo == 1) & (bhi - blo == 1)  # two leaves: the bits that are left count at once
        if lone.any():
            a, b = alo[lone], blo[lone]
            near = np.bitwise_count(f[a] ^ f[b]) <= budget
            left.append(a[near])
            right.append(b[near])
            alo, ahi, blo, bhi, err = (x[~lone] for x in (alo, ahi, blo, bhi, err))
    none = np.zeros(0, np.int64)
    return order[np.concatenate([none, *left])], order[np.concatenate([none, *right])]


def least_of_component(n: int, left, right):
    """For nodes 0 to n - 1, the least node of each one's component."""
    import numpy as np

    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        after = label.copy()
        np.minimum.at(after, label[left], low)
        np.minimum.at(after, label[right], low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    while (label[label] != label).any():
        label = label[label]
    return label


def _blocks(bits: int, parts: int) -> list[tuple[int, int]]:
    """(shift, size) of parts that make up so many bits."""
    sizes = [bits // parts + (i < bits % parts) for i in range(parts)]
    return [(sum(sizes[:i]), s) for i, s in enumerate(sizes)]


def _dealt(rows: DataFrame, bits: int, parts: int) -> DataFrame:
    """Each row to a group for each block of its `rest` of so many bits; the block then leaves rest."""

    def group(shift: int, size: int, i: int) -> Column:
        rest = F.col("rest")
        low = rest.bitwiseAND(F.lit((1 << shift) - 1))
        over = F.lit(0).cast("long") if shift + size >= 64 else F.shiftleft(F.shiftrightunsigned(rest, shift + size), shift)
        value = F.shiftrightunsigned(rest, shift).bitwiseAND(F.lit((1 << size) - 1))
        return F.struct(F.xxhash64(F.col("key"), F.lit(i), value).alias("key"), over.bitwiseOR(low).alias("rest"))

    groups = F.array(*[group(shift, size, i) for i, (shift, size) in enumerate(_blocks(bits, parts))])
    return rows.select("fp", F.explode(groups).alias("g")).select("fp", "g.key", "g.rest")


def _linked(rows: DataFrame, budget: int, shards: int) -> DataFrame:
    """Links of the groups of rows (fp, key): in each shard a star for each component found there."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        key = table.column("key").to_numpy()
        fp = np.ascontiguousarray(table.column("fp").to_numpy()).view(np.uint64)
        node, at = np.unique(fp, return_inverse=True)
        i, j = trie_links(key, fp, budget)
        least = least_of_component(len(node), at[i], at[j])
        u = np.flatnonzero(least != np.arange(len(node)))
        return pa.table({"u": node[u].view(np.int64), "v": node[least[u]].view(np.int64)})

    shard = F.pmod("key", F.lit(shards)).alias("shard")
    return rows.select("fp", "key", shard).groupBy("shard").applyInArrow(run, "u long, v long")


def links(prints: DataFrame, budget: int = 3, group_limit: int = 4096, shard_rows: int = 100_000) -> DataFrame:
    """(u, v) between distinct fingerprints of column fp, enough to join all that are within budget bits."""
    spark, n = prints.sparkSession, prints.count()
    rows, bits, out = prints.select("fp", F.lit(0).cast("long").alias("key"), F.col("fp").alias("rest")), 64, None
    parts = budget + 1
    while True:
        rows = _dealt(rows, bits, parts)
        bits -= bits // parts  # the least that any block takes away, so that rest always fits
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), parts * n // shard_rows + 1)
        big = None
        if 1 << bits > group_limit:
            big = kept(rows.groupBy("key").count().where(F.col("count") > group_limit).select("key"), "simhash-groups")
            big = None if big.isEmpty() else big
        now = _linked(rows if big is None else rows.join(big, "key", "left_anti"), budget, shards)
        out = now if out is None else out.union(now)
        if big is None:
            return out
        rows = rows.join(big, "key", "left_semi").select("fp", "key", "rest")


def _named(nodes: DataFrame, budget: int, group_limit: int) -> DataFrame:
    """(fp, least): for each fingerprint of nodes (fp, first) the least `first` of its component."""
    rooted = components(links(nodes, budget, group_limit))
    known = nodes.join(rooted.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = known.join(rooted.select("root").distinct(), "root", "left_semi").groupBy("root").agg(F.min("first").alias("least"))
    return known.join(least, "root", "left").select("fp", F.coalesce("least", "first").alias("least"))


def near_duplicates(docs: DataFrame, width: int = 3, budget: int = 3, group_limit: int = 4096) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each document."""
    each = kept(fingerprints(docs.select("doc_id", "text"), width), "simhash")
    nodes = kept(each.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    named = _named(nodes, budget, group_limit)
    return each.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


def only(docs: DataFrame, chosen: DataFrame, repeated: bool) -> DataFrame:
    """The rows of docs whose doc_id and hash of id and text are in chosen (id, rid), one of each if there are repeated rows."""
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("doc_id", "text").alias("rid"))
    same = (F.col("a.rid") == F.col("b.rid")) & F.col("a.id").eqNullSafe(F.col("b.id"))
    left = whole.alias("a").join(chosen.alias("b"), same, "left_semi")
    return (left.dropDuplicates(["id", "rid"]) if repeated else left).select("row.*")


def representatives(docs: DataFrame, width: int = 3, budget: int = 3, group_limit: int = 4096) -> DataFrame:
    """docs with one row of each component: that of the least doc_id (null ids last; between repeated rows, any one)."""
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("doc_id", "text").alias("rid"))
    each = kept(fingerprints(docs.select(own.alias("doc_id"), "text"), width), "simhash")
    nodes = kept(each.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    chosen = kept(_named(nodes, budget, group_limit).select("least.id", "least.rid").distinct(), "simhash-chosen")
    repeated = not each.groupBy("doc_id").count().where("count > 1").isEmpty()
    forget(each, nodes)
    return only(docs, chosen, repeated)
