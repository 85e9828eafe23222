"""Near-duplicate vectors by product quantisation: coarse inverted lists, residual codes, table distances, exact rerank.

Unit vectors of cosine c or more lie within e = sqrt(2 - 2c) of each other. Every vector goes to the list of its nearest
centroid. The bisecting plane of two centroids separates their lists, so a vector is never nearer to one of another list
than to the plane, and of a pair within e one at least is e / 2 or less from it: a vector therefore visits just the lists
whose planes are that near, and no link is lost. If both visit each other, the pair counts in the list of the lesser number.
Within a list, residents are codes of their residuals, a byte for each subspace, and the length of what the codes leave
out. A visitor's distances to the codes come from tables, one for each subspace; where they are more than e and that
length apart, the pair is out; the others are compared by cosine in double precision. So recall is 1 by construction.

Centroids and code books are fitted on at most `sample` vectors; they decide what work there is, never what links. There is
a list for each `per_list` different vectors, at most `most_lists`; a list of more than `limit` residents or visitors is
dealt over a grid of tasks, each with limit of either at most. Equal vectors of a label are one from the start. A task
sends back a row for each vector with links, its count and one link to the least of its group, never pairs.

Defined cases: null, empty or zero vectors, those with null or non-finite components, and those of a null label link with
nothing; neither do vectors of different lengths. Repeated rows are links of each other and come out once each. A null
vec_id never names a component; one of null ids alone has a null component_id and is kept. An empty table gives an empty
one. Only vec_id, label and embedding are read, whatever other columns there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, kept
from .components import components
from .simhash import least_of_component


def _units(x):
    """Rows of length one, in double precision; no row is zero. The result of a row doesn't depend on the others."""
    import numpy as np

    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _dense(column, dims: int):
    """An Arrow list column as rows of doubles, shorter ones padded with zeros."""
    import numpy as np

    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(lengths), dims))
    out[np.arange(dims) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _distances(x, centres):
    """Squared distances of all rows to all centres."""
    return (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1) - 2 * x @ centres.T


def k_means(x, k: int, rounds: int = 8):
    """Centres of x after some rounds from its first k rows; a centre without rows stays where it is."""
    import numpy as np

    centres = x[:k].copy()
    for _ in range(rounds):
        near = _distances(x, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


class Quantiser:
    """Centroids of lists, and a code book of up to 256 entries for each subspace of the residuals."""

    def __init__(self, x, lists: int, subspaces: int):
        import numpy as np

        self.centres = k_means(x, lists)
        left = x - self.centres[_distances(x, self.centres).argmin(axis=1)]
        cuts = np.linspace(0, x.shape[1], min(subspaces, x.shape[1]) + 1).astype(int)
        self.spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
        self.books = [k_means(left[:, a:b], 256) for a, b in self.spans]

    def codes(self, left):
        """(codes, what they leave out as a length) of residuals."""
        import numpy as np

        codes = np.stack([_distances(left[:, a:b], book).argmin(axis=1) for (a, b), book in zip(self.spans, self.books)], axis=1).astype(np.uint8)
        decoded = np.concatenate([book[codes[:, m]] for m, book in enumerate(self.books)], axis=1)
        return codes, np.sqrt(((left - decoded) ** 2).sum(axis=1))

    def tables(self, left):
        """For each subspace the squared distances of residuals to all entries of its book."""
        return [_distances(left[:, a:b], book).astype("f4") for (a, b), book in zip(self.spans, self.books)]

    def visits(self, x, home, reach: float):
        """Which other lists' planes are within reach of each row."""
        import numpy as np

        d = _distances(x, self.centres)
        apart = np.sqrt(np.maximum(_distances(self.centres, self.centres), 1e-24))[home]
        near = (d - d[np.arange(len(x)), home][:, None]) / (2 * apart) <= reach
        near[np.arange(len(x)), home] = False
        return near


def usable(label: Column, vector: Column) -> Column:
    """Vectors that can link: of a label, of finite components, not all zero."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(vector, lambda v: v != 0)
    return F.coalesce(label.isNotNull() & fine, F.lit(False))


def classes(vectors: DataFrame) -> DataFrame:
    """(cid, label, embedding, least, n): each usable vector of a label once, the least vec_id that has it and how many rows do."""
    same = vectors.where(usable(F.col("label"), F.col("embedding"))).groupBy("label", "embedding")
    return same.agg(F.min("vec_id").alias("least"), F.count("*").alias("n")).withColumn("cid", F.monotonically_increasing_id())


def fitted(distinct: DataFrame, dims: int, lists: int, subspaces: int, sample: int) -> Quantiser:
    """A quantiser of `sample` vectors at most, those of the least hashes."""
    rows = distinct.select("cid", "embedding").orderBy(F.xxhash64("cid"), "cid").limit(sample).select("embedding").toArrow()
    return Quantiser(_units(_dense(rows.column(0).combine_chunks(), dims)), lists, subspaces)


def placed(distinct: DataFrame, quantiser: Quantiser, dims: int, reach: float) -> DataFrame:
    """(cid, label, size, n, embedding, home, visits) of each class."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x = _units(_dense(batch.column(4), dims)) if batch.num_rows else np.zeros((0, dims))
            home = _distances(x, quantiser.centres).argmin(axis=1)
            near = quantiser.visits(x, home, reach)
            rows, lists = np.nonzero(near)
            offsets = np.r_[0, np.cumsum(np.bincount(rows, minlength=len(x)))]
            visits = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(lists, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home, pa.int32()), visits], [*batch.schema.names, "home", "visits"])

    kinds = {f.name: f.dataType.simpleString() for f in distinct.schema}
    own = distinct.select("cid", "label", F.size("embedding").alias("size"), "n", "embedding")
    return own.mapInArrow(run, f"cid long, label {kinds['label']}, size int, n long, embedding {kinds['embedding']}, home int, visits array<int>")


def grid(rows: DataFrame, limit: int) -> DataFrame:
    """rows of placed(), each where it meets others: list, tile and part; host tells residents of a list from its visitors."""
    key = ["label", "size", "list"]
    salt = F.xxhash64("cid")
    resident = rows.groupBy("label", "size", F.col("home").alias("list")).agg(F.count("*").alias("r"))
    visitor = rows.select("label", "size", F.explode("visits").alias("list")).groupBy(*key).agg(F.count("*").alias("v"))
    met = resident.join(visitor, key, "left").withColumn("tiles", F.ceil(F.col("r") / limit))
    among = F.coalesce("v", F.lit(0)) + F.when(F.col("tiles") > 1, F.col("r")).otherwise(0)
    met = met.select(*key, "tiles", F.greatest(F.ceil(among / limit), F.lit(1)).alias("parts"))

    own = rows.withColumn("list", F.col("home")).join(met, key)
    tile, part = F.pmod(salt, "tiles"), F.pmod(salt, "parts")
    hosts = own.select("*", tile.alias("tile"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(True).alias("host"))
    # Residents meet the other tiles of their list, those of lesser numbers, as visitors.
    within = own.where(tile > 0).select("*", F.explode(F.sequence(F.lit(0).cast("long"), tile - 1)).alias("tile"), part.alias("part"), F.lit(False).alias("host"))
    guests = rows.select("*", F.explode("visits").alias("list")).join(met, key)
    guests = guests.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("tile"), part.alias("part"), F.lit(False).alias("host"))
    names = [*key, "tile", "part", "host", "cid", "n", "embedding", "home", "visits"]
    return hosts.select(names).union(within.select(names)).union(guests.select(names))


def tallied(meeting: DataFrame, quantiser: Quantiser, dims: int, least_cosine: float, block: int = 512) -> DataFrame:
    """(cid, links, peer) for vectors with links in a group: how many rows they link with there, and the least of their component there."""
    reach = (2 - 2 * least_cosine) ** 0.5

    def run(key, table):
        import numpy as np
        import pyarrow as pa

        here = key[2].as_py()
        table = table.combine_chunks()
        host = table.column("host").to_numpy(zero_copy_only=False).astype(bool)
        ids, n = table.column("cid").to_numpy(), table.column("n").to_numpy()
        home = table.column("home").to_numpy()
        x = _units(_dense(table.column("embedding").combine_chunks(), dims))
        left = x - quantiser.centres[here]
        hosts, guests = np.flatnonzero(host), np.flatnonzero(~host)
        codes, lost = quantiser.codes(left[hosts])
        bound = ((reach + lost) ** 2 + 1e-4).astype("f4")
        visits = table.column("visits").combine_chunks().take(pa.array(hosts))
        also = np.zeros((len(hosts), len(quantiser.centres)), bool)
        also[np.repeat(np.arange(len(hosts)), np.diff(visits.offsets.to_numpy())), visits.flatten().to_numpy()] = True
        links, ends = np.zeros(len(x), np.int64), []
        label = np.arange(len(x))
        first = key[4].as_py() == 0  # hosts meet each other in one part only

        def meet(rows, among, allowed):
            """Count links of the vectors `rows` with the hosts `among`, as far as allowed."""
            d = np.zeros((len(rows), len(among)), "f4")
            for m, table_of in enumerate(quantiser.tables(left[rows])):
                d += table_of[:, codes[among, m]]
            allowed &= d <= bound[among]
            r, c = np.flatnonzero(allowed.any(axis=1)), np.flatnonzero(allowed.any(axis=0))
            if not len(r):
                return
            allowed = allowed[np.ix_(r, c)]
            rows, cols = rows[r], hosts[among[c]]
            cosine = x[rows] @ x[cols].T
            i, j = np.nonzero(allowed & (np.abs(cosine - least_cosine) < 1e-9))  # too near to leave to the order of sums
            cosine[i, j] = (x[rows[i]] * x[cols[j]]).sum(axis=1)
            hit = allowed & (cosine >= least_cosine)
            np.add.at(links, rows, hit @ n[cols])
            np.add.at(links, cols, n[rows] @ hit)
            i, j = np.nonzero(hit)
            if len(i):
                part = np.r_[rows, cols]
                root = least_of_component(len(part), i, j + len(rows))
                ends.append((part, part[root]))

        for a in range(0, len(hosts), block):
            near = np.arange(a, min(a + block, len(hosts)))
            for b in range(0, a + 1 if first else 0, block):
                far = np.arange(b, min(b + block, len(hosts)))
                meet(hosts[near], far, near[:, None] > far)
            for b in range(0, len(guests), block):
                rows = guests[b : b + block]
                once = (home[rows][:, None] == here) | ~also[near][:, home[rows]].T | (here < home[rows][:, None])
                meet(rows, near, once)
        if ends:
            u, v = (np.concatenate(e) for e in zip(*ends))
            label = least_of_component(len(x), u, v)
        some = np.flatnonzero(links)
        return pa.table({"cid": ids[some], "links": links[some], "peer": ids[label[some]]})

    return meeting.groupBy("label", "size", "list", "tile", "part").applyInArrow(run, "cid long, links long, peer long")


def near_vectors(
    vectors: DataFrame, least_cosine: float = 0.98, sample: int = 1 << 15, per_list: int = 1024, most_lists: int = 4096, subspaces: int = 8, limit: int = 8192
) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row; links are pairs of equal labels with that cosine or more."""
    distinct = kept(classes(vectors), "vector-classes")
    count, dims = distinct.agg(F.count("*"), F.max(F.size("embedding"))).first()
    rows = vectors.select("vec_id", "label", "embedding")
    if not count:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    lists = min(-(-count // per_list), most_lists, sample)
    reach = (2 - 2 * least_cosine) ** 0.5
    quantiser = fitted(distinct, dims, lists, subspaces, sample)
    homes = kept(placed(distinct, quantiser, dims, reach / 2 + 1e-7), "vector-lists")
    tally = kept(tallied(grid(homes, limit), quantiser, dims, least_cosine), "vector-links")
    forget(homes)
    sums = tally.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = components(tally.select(F.col("cid").alias("u"), F.col("peer").alias("v")))
    member = distinct.drop("embedding", "label").join(roots, F.col("cid") == F.col("node"), "left").select("cid", "least", "n", F.coalesce("root", "cid").alias("root"))
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    known = member.join(least, "root").join(sums, "cid", "left").select("cid", "component_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    known = kept(distinct.select("cid", F.col("label").alias("l"), F.col("embedding").alias("e")).join(known, "cid"), "vector-known")
    forget(tally, distinct)
    fine = usable(F.col("label"), F.col("embedding"))
    linked = rows.where(fine).join(known, (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e"))).select("vec_id", "n_links", "component_id")
    alone = rows.where(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
