"""Vector clustering for pruning (C1, C2, C2b, C4, C5, C6 via remap, J8, P18, A22).

Vectors are ``(token_id, vec ARRAY<DOUBLE>)``; searches run over packed blocks of them
(:mod:`.vectors`).

* k-means (C1): points and centres are tables of blocks.  A task holds some blocks of points
  and meets blocks of centres one after another; the best of all centre blocks and the partial sums of the new
  centres are put together per block, so neither points nor centres go through the driver
  and any k will do.  A point that equals a centre needs no search, and one whose centre has not moved is
  compared with the moved centres alone.  Initial centres: the k smallest ``md5(seed:token_id)``; ties go to
  the lowest centre id; an empty cluster keeps its centre.  It ends after ``rounds``, or
  before that when no centre moves; ``rounds=None`` runs until none does.
  ``engine="mllib"`` runs ``pyspark.ml.clustering.KMeans`` instead.
* eps-graph clusters (C2) = connected components of the cosine-eps graph (DBSCAN with
  ``min_samples=2`` has no border points).  Pairs of blocks are compared with a partial
  product and, where the norms of the rest allow it, the whole one; a task hands on
  spanning stars of its close points.  Components by min-label propagation with pointer
  jumping and a checkpoint per round.
* Average linkage (C3) and merging by it (C2a) are in :mod:`.linkage`.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import l2_normalise
from . import vectors as V
from .ordering import checkpoint_once, scalar, stored, with_row_number
from .rank import parameter_keep_count, union_keep


def sq_dist(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0).cast("double"),
                       lambda acc, v: acc + v)


def as_double_vec(df: DataFrame, col: str = "embedding", out: str = "vec") -> DataFrame:
    return df.withColumn(out, F.transform(col, lambda x: x.cast("double"))).drop(col) if col != out else df


def normalise(vecs: DataFrame, col: str = "vec") -> DataFrame:
    """Unit-length vectors (the zero vector becomes NULL entries)."""
    return vecs.withColumn(col, l2_normalise(F.col(col)))


def mean_vectors(labelled: DataFrame, col: str = "vec", key: str = "cluster") -> DataFrame:
    """Element-wise mean vector per cluster: ``(key, centre)``.

    Tasks add up their rows by cluster first, so a cluster holding a third of the points is
    a few partial sums by the time it is shuffled."""
    kind = labelled.schema[key].dataType.simpleString()

    def rows(keys, n, total):
        return pa.RecordBatch.from_arrays(
            [keys, pa.array(n, pa.int64()),
             pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * total.shape[1], pa.int32()), pa.array(total.ravel()))],
            names=["k", "n", "total"])

    def add(batches, weighted):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            coded = batch.column("k").dictionary_encode()
            at = np.asarray(coded.indices)
            x = V.matrix(batch, "total" if weighted else "v")
            total = np.zeros((len(coded.dictionary), x.shape[1]))
            np.add.at(total, at, x)
            n = np.bincount(at, batch.column("n").to_numpy() if weighted else None, len(coded.dictionary))
            yield rows(coded.dictionary, n.astype(np.int64), total)
    schema = f"k {kind}, n long, total array<double>"
    part = labelled.select(F.col(key).alias("k"), F.col(col).alias("v")).mapInArrow(lambda b: add(b, False), schema)
    cells = part.select("k", "n", F.posexplode("total").alias("p", "x"))
    sums = cells.groupBy("k", "p").agg((F.sum("x") / F.sum("n")).alias("m"))
    return (sums.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("p", "m"))).alias("s"))
                .select(F.col("k").alias(key), F.transform("s", lambda s: s["m"]).alias("centre")))


def initial_centres(vecs: DataFrame, k: int, seed: int = 42, col: str = "vec") -> DataFrame:
    r = with_row_number(vecs.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col("token_id").cast("string")))),
                        [F.col("_h").asc(), F.col("token_id").asc()], name="_r")
    return r.filter(F.col("_r") <= k).select((F.col("_r") - 1).cast("int").alias("cluster"),
                                             F.col(col).alias("centre"))


_BEST = "blk int, c_blk int, ids binary, cluster binary, dist binary, mat binary"
_BEST_ARROW = pa.schema([("blk", pa.int32()), ("c_blk", pa.int32()), ("ids", pa.binary()), ("cluster", pa.binary()),
                         ("dist", pa.binary()), ("mat", pa.binary())])


def _best_of_block(points: DataFrame, centres: DataFrame, p_blocks: int, c_blocks: int) -> DataFrame:
    """For each block of points and each strip of blocks of centres: the nearest of these centres."""
    def rows(best):
        for blk, (c_blk, ids, cluster, dist) in best.items():
            yield pa.RecordBatch.from_pylist(
                [{"blk": blk, "c_blk": c_blk, "ids": ids.tobytes(), "cluster": cluster.tobytes(),
                  "dist": dist.tobytes(), "mat": None}], schema=_BEST_ARROW)

    def run(batches):
        now, best = None, {}
        for cell, blk, c_blk, (ids, x), (clusters, mat) in V.each_pair(batches):
            if cell != now:
                yield from rows(best)
                now, best = cell, {}
            place, dist = V.nearest_rows(x, mat)
            cluster = clusters[place]
            if blk in best:
                # centre blocks come in order, so the lowest centre keeps a tie
                c_blk, _, c, d = best[blk]
                nearer = dist < d
                cluster, dist = np.where(nearer, cluster, c), np.where(nearer, dist, d)
            best[blk] = (c_blk, ids, cluster, dist)
        yield from rows(best)
    return V.pairs(points, centres, p_blocks, c_blocks).mapInArrow(run, _BEST)


def _by_block(best: DataFrame, blocks: int):
    """The rows of each block of points next to each other."""
    n = min(blocks, V.tasks_of(best))
    return best.repartition(n, "blk").sortWithinPartitions("blk", F.col("mat").isNotNull(), "c_blk")


def _reduced(batches):
    """``(blk, ids, cluster, dist, mat)`` of each block: the nearest centre of all its rows."""
    held = None
    for batch in batches:
        for i in range(batch.num_rows):
            get = lambda c: batch.column(c)[i].as_py()  # noqa: E731, B023
            blk = get("blk")
            if held is not None and held[0] != blk:
                yield held
                held = None
            if get("mat") is not None:
                held = (*held[:4], np.frombuffer(get("mat"), "<f8").reshape(len(held[1]), -1))
                continue
            ids, cluster, dist = (np.frombuffer(get(c), t) for c, t in (("ids", "<i8"), ("cluster", "<i8"), ("dist", "<f8")))
            if held is None:
                held = (blk, ids, cluster, dist, None)
            else:
                # centre blocks come in order, so the lowest centre keeps a tie
                nearer = dist < held[3]
                held = (blk, ids, np.where(nearer, cluster, held[2]), np.where(nearer, dist, held[3]), None)
    if held is not None:
        yield held


_ASSIGNED = "row long, cluster long, dist double"


def _nearest(rows: DataFrame, n: int, dim: int, centres: DataFrame, c_blocks: int) -> DataFrame:
    """``(row, cluster, dist)`` of ``n`` points ``(row, vec)``: the nearest of the centres."""
    def flat(batches):
        for _, ids, cluster, dist, _ in _reduced(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(cluster), pa.array(dist)], names=["row", "cluster", "dist"])
    blocks = V.block_count(n, dim, V.tasks_of(rows))
    return _by_block(_best_of_block(V.pack(rows, blocks, key="row"), centres, blocks, c_blocks), blocks).mapInArrow(flat, _ASSIGNED)


def _digests(mat: np.ndarray) -> pa.Array:
    """Equal vectors have equal digests; a vector with a value that is no number has none."""
    rows = np.ascontiguousarray(mat + 0.0)  # no -0.0
    odd = np.isnan(rows).any(axis=1).tolist()
    return pa.array([None if o else blake2b(r, digest_size=16).digest() for o, r in zip(odd, rows)], pa.binary())


def _equal(points: DataFrame, centres: DataFrame) -> DataFrame:
    """Points that equal a centre, which no other is nearer to: ``(row, cluster, dist)`` with the lowest of them."""
    def keys(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, mat = V.unpacked(batch.column("ids")[i].as_py(), batch.column("mat")[i].as_py())
                own = (batch.column("blk")[i].as_py() << 32) + np.arange(len(ids))
                yield pa.RecordBatch.from_arrays([_digests(mat), pa.array(own), pa.array(ids)], names=["key", "row", "id"])
    hashed = lambda df: df.select("blk", "ids", "mat").mapInArrow(keys, "key binary, row long, id long").filter("key is not null")
    first = hashed(centres).groupBy("key").agg(F.min("id").alias("cluster"))
    return hashed(points).join(first, "key").select("row", "cluster", F.lit(0.0).alias("dist"))


def _of_blocks(points: DataFrame, rows: DataFrame, *cols: str) -> DataFrame:
    """Blocks of points with the places and the given columns of those of their points that ``rows`` names."""
    at = rows.select(F.expr("cast(shiftright(row, 32) as int)").alias("blk"), (F.col("row") % (1 << 32)).cast("int").alias("at"), *cols)
    some = at.groupBy("blk").agg(F.collect_list(F.struct("at", *cols)).alias("some"))
    return points.join(some, "blk").select("blk", "ids", "mat", "some")


def _each_of_blocks(batches, *cols: str):
    """``(blk, ids, mat, at, columns...)`` of the rows of :func:`_of_blocks`, places in order."""
    for batch in batches:
        for i in range(batch.num_rows):
            some = batch.column("some")[i].values
            at = some.field("at").to_numpy()
            order = np.argsort(at, kind="stable")
            yield (batch.column("blk")[i].as_py(), *V.unpacked(batch.column("ids")[i].as_py(), batch.column("mat")[i].as_py()),
                   at[order], *(some.field(c).to_numpy()[order] for c in cols))


def _vectors_of(points: DataFrame, rows: DataFrame) -> DataFrame:
    """``(row, vec)`` of the points that ``rows`` names."""
    def run(batches):
        for blk, _, mat, at in _each_of_blocks(batches):
            part = mat[at]
            yield pa.RecordBatch.from_arrays(
                [pa.array((blk << 32) + at.astype(np.int64)),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * part.shape[1], pa.int32()), pa.array(part.ravel()))],
                names=["row", "vec"])
    return _of_blocks(points, rows).mapInArrow(run, "row long, vec array<double>")


def _moved(centres: DataFrame) -> DataFrame:
    """The blocks of the centres that the last round moved."""
    def run(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                ids, mat = V.unpacked(batch.column("ids")[i].as_py(), batch.column("mat")[i].as_py())
                some = np.frombuffer(batch.column("mask")[i].as_py(), bool)
                out.append(V.packed(batch.column("blk")[i].as_py(), ids[some], mat[some]))
            yield pa.RecordBatch.from_pylist([x for x in out if x["n"]], schema=V._BLOCK)
    return centres.mapInArrow(run, V.BLOCK)


def _assigned(points: DataFrame, dim: int, centres: DataFrame, c_blocks: int, before: DataFrame | None) -> DataFrame:
    """``(row, cluster, dist)``: the nearest centre of each point, by searches for those points alone that need one.
    A point that equals a centre is nearest to it.  ``before``: the nearest centres of the round
    before; a point whose centre has not moved compares it with the moved ones alone."""
    equal = stored(_equal(points, centres), "equal-points")
    parts = [equal]
    if before is None:
        def run(batches):
            for batch in batches:
                for blk, n in zip(batch.column("blk").to_pylist(), batch.column("n").to_pylist()):
                    yield pa.RecordBatch.from_arrays([pa.array((blk << 32) + np.arange(n))], names=["row"])
        whole = points.select("blk", "n").mapInArrow(run, "row long").join(equal, "row", "left_anti")
        kept = None
    else:
        def ids(batches):
            for batch in batches:
                for x in batch.column("ids").to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, "<i8"))], names=["cluster"])
        moved = stored(_moved(centres), "moved-centres")
        gone = moved.select("ids").mapInArrow(ids, "cluster long")
        other = before.join(equal, "row", "left_anti")
        whole = other.join(gone, "cluster", "left_semi").select("row")
        kept = stored(other.join(gone, "cluster", "left_anti").select("row", "cluster", "dist"), "kept-points")
    whole = stored(whole, "points-to-search")
    if n := whole.count():
        parts.append(_nearest(_vectors_of(points, whole), n, dim, centres, c_blocks))
    if kept is not None and (n := kept.count()):
        if not moved.isEmpty():
            near = _nearest(_vectors_of(points, kept), n, dim, moved, c_blocks)
            kept = (kept.unionByName(near).groupBy("row").agg(F.min(F.struct("dist", "cluster")).alias("m"))
                        .select("row", "m.cluster", "m.dist"))
        parts.append(kept)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return stored(out, "assigned")


_SUMS = "c_blk int, ids binary, n binary, total binary, old binary"
_SUMS_ARROW = pa.schema([("c_blk", pa.int32()), ("ids", pa.binary()), ("n", pa.binary()), ("total", pa.binary()),
                         ("old", pa.binary())])
_CENTRES = V.BLOCK + ", moved long, mask binary"


def _sums(clustered, c_rows: int):
    """Sums by cluster of each block of ``(clusters, matrix)``, cut by the blocks of the centres."""
    for cluster, x in clustered:
        some, at = np.unique(cluster, return_inverse=True)
        total = np.zeros((len(some), x.shape[1]))
        np.add.at(total, at, x)
        n = np.bincount(at, minlength=len(some))
        of = some // c_rows
        cut = np.concatenate(([0], np.flatnonzero(np.diff(of)) + 1, [len(of)])) if len(of) else [0]
        yield pa.RecordBatch.from_pylist(
            [{"c_blk": int(of[a]), "ids": some[a:b].tobytes(), "n": n[a:b].tobytes(), "total": total[a:b].tobytes(),
              "old": None} for a, b in zip(cut[:-1], cut[1:])], schema=_SUMS_ARROW)


def _sums_of_search(points: DataFrame, centres: DataFrame, p_blocks: int, c_blocks: int, c_rows: int) -> DataFrame:
    """Sums of a search for the nearest centre of every point."""
    mats = points.select("blk", F.lit(None).cast("int").alias("c_blk"), "ids", F.lit(None).cast("binary").alias("cluster"),
                         F.lit(None).cast("binary").alias("dist"), "mat")
    best = _by_block(_best_of_block(points, centres, p_blocks, c_blocks).unionByName(mats), p_blocks)
    return best.mapInArrow(lambda batches: _sums(((c, x) for _, _, c, _, x in _reduced(batches)), c_rows), _SUMS)


def _sums_of_assigned(points: DataFrame, assigned: DataFrame, c_rows: int) -> DataFrame:
    return _of_blocks(points, assigned, "cluster").mapInArrow(
        lambda batches: _sums(((c, x) for _, _, x, _, c in _each_of_blocks(batches, "cluster")), c_rows), _SUMS)


def _next_centres(points: DataFrame, centres: DataFrame, sums: DataFrame, c_blocks: int) -> DataFrame:
    """One round: blocks of the new centres, with the number and a mask of those that moved."""
    def new(batches):
        schema = pa.schema([*V._BLOCK, ("moved", pa.int64()), ("mask", pa.binary())])

        def done():
            some = n > 0
            fresh = old.copy()
            fresh[some] = total[some] / n[some, None]
            mask = (fresh != old).any(axis=1)
            return pa.RecordBatch.from_pylist(
                [V.packed(blk, ids, fresh) | {"moved": int(mask.sum()), "mask": mask.tobytes()}], schema=schema)
        blk = None
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c: batch.column(c)[i].as_py()  # noqa: E731, B023
                if get("old") is not None:
                    if blk is not None:
                        yield done()
                    blk = get("c_blk")
                    ids, old = V.unpacked(get("ids"), get("old"))
                    total, n = np.zeros(old.shape), np.zeros(len(ids), np.int64)
                    continue
                at = np.searchsorted(ids, np.frombuffer(get("ids"), "<i8"))
                total[at] += np.frombuffer(get("total"), "<f8").reshape(len(at), -1)
                n[at] += np.frombuffer(get("n"), "<i8")
        if blk is not None:
            yield done()
    none = F.lit(None).cast("binary")
    part = sums.unionByName(
        centres.select(F.col("blk").alias("c_blk"), "ids", none.alias("n"), none.alias("total"), F.col("mat").alias("old")))
    tasks = min(c_blocks, V.tasks_of(points))
    ordered = part.repartition(tasks, "c_blk").sortWithinPartitions("c_blk", F.col("old").isNull())
    return ordered.mapInArrow(new, _CENTRES)


LEAST_PRODUCTS = 1 << 28
"""Pairs of points and centres a round from which on points that need no search are looked for."""


def kmeans(vecs: DataFrame, k: int, seed: int = 42, rounds: int | None = 5, col: str = "vec",
           engine: str = "fixed", least: int = LEAST_PRODUCTS) -> tuple[DataFrame, DataFrame]:
    """Returns ``(labels (token_id, cluster, dist), centres (cluster, centre))``."""
    if engine == "mllib":
        return _kmeans_mllib(vecs, k, seed, col)
    vecs = stored(vecs.select("token_id", col), "points")
    size = vecs.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(col)).alias("d")).first()
    spark, n, dim = vecs.sparkSession, size["n"], size["d"] or 1
    if n == 0 or k <= 0:
        return (spark.createDataFrame([], "token_id int, cluster int, dist double"),
                spark.createDataFrame([], "cluster int, centre array<double>"))
    p_blocks, c_blocks = V.block_count(n, dim, V.tasks_of(vecs)), V.block_count(min(k, n), dim, 0)
    c_rows = -(-min(k, n) // c_blocks)
    points = stored(V.pack(vecs, p_blocks, col=col), "point-blocks")
    centres = stored(V.pack(initial_centres(vecs, k, seed, col), c_blocks, by=F.floor(F.col("cluster") / c_rows).cast("int"),
                            key="cluster", col="centre"), "centre-blocks")
    # few centres a point, or few products: every round searches for every point in one job
    every = 4 * k < n or n * min(k, n) < least
    done, near, still = 0, None, False
    while not still and (rounds is None or done < rounds):
        if every:
            sums = _sums_of_search(points, centres, p_blocks, c_blocks, c_rows)
        else:
            near = _assigned(points, dim, centres, c_blocks, near)
            sums = _sums_of_assigned(points, near, c_rows)
        centres = stored(_next_centres(points, centres, sums, c_blocks), "centre-blocks")
        done += 1
        still = not scalar(centres, F.sum("moved"))
    kind = vecs.schema["token_id"].dataType.simpleString()

    def labels(batches):
        for ids, cluster, dist in (((ids, c, d) for _, ids, c, d, _ in _reduced(batches)) if every else
                                   ((ids[at], c, d) for _, ids, _, at, c, d in _each_of_blocks(batches, "cluster", "dist"))):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(cluster.astype(np.int32)), pa.array(dist)],
                                             names=["token_id", "cluster", "dist"])

    def rows(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, mat = V.unpacked(batch.column("ids")[i].as_py(), batch.column("mat")[i].as_py())
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * mat.shape[1], pa.int32()), pa.array(mat.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), flat], names=["cluster", "centre"])
    if every:
        found = _by_block(_best_of_block(points, centres, p_blocks, c_blocks), p_blocks)
    else:
        # centres that have not moved leave the last search as it is
        found = _of_blocks(points, near if still else _assigned(points, dim, centres, c_blocks, near), "cluster", "dist")
    lab = found.mapInArrow(labels, "token_id long, cluster int, dist double")
    return (stored(lab.withColumn("token_id", F.col("token_id").cast(kind)), "labels"),
            centres.mapInArrow(rows, "cluster int, centre array<double>"))


def _kmeans_mllib(vecs, k, seed, col):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    data = vecs.withColumn("features", array_to_vector(col))
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(data)
    lab = model.transform(data).drop("features")
    centres = model.clusterCenters()
    spark = vecs.sparkSession
    cdf = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)],
                                "cluster int, centre array<double>")
    return lab.join(F.broadcast(cdf), "cluster").withColumn("dist", sq_dist(F.col(col), F.col("centre"))) \
              .drop("centre"), cdf


def representatives(labels: DataFrame, vecs: DataFrame | None = None, col: str = "vec") -> DataFrame:
    """Per cluster the token nearest to its centre (``dist`` column, or the mean
    of ``vecs`` when given); ties -> lowest token id.  ``(cluster, rep_id)``."""
    lab = labels
    if vecs is not None:
        raw = labels.select("token_id", "cluster").join(vecs.select("token_id", col), "token_id")
        cent = mean_vectors(raw, col)
        lab = raw.join(cent, "cluster").withColumn("dist", sq_dist(F.col(col), F.col("centre")))
    return lab.groupBy("cluster").agg(
        F.min_by("token_id", F.struct(F.col("dist"), F.col("token_id"))).alias("rep_id"))


def cluster_sizes(labels: DataFrame) -> DataFrame:
    """Cluster size -> number of clusters of that size."""
    s = labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    return s.groupBy("size").agg(F.count(F.lit(1)).alias("clusters"))


def cluster_removed(removed_ids: DataFrame, keep: DataFrame, vecs: DataFrame, k: int = 50,
                    seed: int = 42, rounds: int = 5) -> tuple[DataFrame, DataFrame]:
    """K-means the removed tokens that have vectors (P11) into ``min(k, n)``
    clusters; representative = nearest to the centre.  Returns
    ``(oov (token_id, rep_id), keep' = keep + representatives appended in cluster order)``."""
    pts = stored(removed_ids.select("token_id").join(vecs, "token_id", "inner"), "removed")
    n = int(scalar(pts, F.count(F.lit(1))))
    if n == 0:
        spark = keep.sparkSession
        return spark.createDataFrame([], "token_id int, rep_id int"), keep
    labels, _ = kmeans(pts, min(k, n), seed, rounds)
    reps = representatives(labels)
    oov = labels.join(reps, "cluster").select(F.col("token_id").cast("int"), F.col("rep_id").cast("int"))
    return oov, union_keep(keep, reps.select(F.col("rep_id").alias("token_id"), "cluster"), "cluster")


def cluster_to(vecs: DataFrame, n: int, method: str = "kmeans", seed: int = 42, rounds: int = 5, eps: float = 0.3) -> DataFrame:
    """``(token_id, cluster)``: ``n`` clusters of the vectors by direction.

    ``kmeans`` (C1), ``agglomerative`` (C3), or ``dbscan``: eps-graph components (C2),
    merged by average linkage (C2a) or split with 2-means (C2b) to the number wanted."""
    from .linkage import average_linkage, merge_clusters
    unit = normalise(vecs)
    if method == "kmeans":
        return kmeans(unit, n, seed, rounds)[0].select("token_id", "cluster")
    if method == "agglomerative":
        return average_linkage(unit, n)
    if method != "dbscan":
        raise ValueError(f"unknown clustering method {method!r}")
    labels = stored(eps_clusters(vecs, eps), "eps-clusters")
    found = int(scalar(labels, F.count_distinct("cluster")))
    if found > n:
        return merge_clusters(labels, unit, n)
    return split_clusters(labels, unit, n, seed, rounds) if found < n else labels


def prune_by_cluster(token_ids: DataFrame, vecs: DataFrame, p: float, seed: int = 42,
                     rounds: int = 5, n_special: int = 5, vocab_rows: int | None = None, dim: int | None = None,
                     total_params: int | None = None, method: str = "kmeans") -> DataFrame:
    """C4: keep the ``n_special`` smallest ids, cluster the rest (normalised vectors, see
    :func:`cluster_to` for ``method``) into ``(n - 5) - int(n * p / 100)`` clusters and keep
    one representative per cluster, nearest to the raw mean.  Returns the keep list
    ``(token_id, new_id)``.

    With ``vocab_rows``, ``dim`` and ``total_params`` the budget ``p`` is a share of all
    parameters (W3): the clusters are as many as it leaves, and all tokens stay, in id
    order, if leaving out the rest of the vocabulary already meets it."""
    pts = stored(token_ids.select("token_id").distinct().join(vecs, "token_id", "inner"), "tokens")
    n = int(scalar(pts, F.count(F.lit(1))))
    first = [r["token_id"] for r in pts.select("token_id").orderBy("token_id").limit(n_special).collect()]  # n_special rows
    spark = pts.sparkSession
    specials = spark.createDataFrame([(int(t), i) for i, t in enumerate(first)], "token_id int, new_id int")
    prunable = pts.filter(F.col("token_id") > first[-1]) if first else pts
    n_clusters = (n - n_special) - int(n * p / 100)
    if total_params:
        n_clusters = parameter_keep_count(n, n - min(n, n_special), p, vocab_rows, dim, total_params, 0)
        if n_clusters is None:
            r = with_row_number(pts.select("token_id"), [F.col("token_id").asc()], name="_r")
            return r.select(F.col("token_id").cast("int"), (F.col("_r") - 1).cast("int").alias("new_id"))
    if n_clusters <= 0:
        return specials
    labels = cluster_to(prunable, n_clusters, method, seed, rounds)
    reps = representatives(labels, prunable)
    return union_keep(specials, reps.select(F.col("rep_id").alias("token_id"), "cluster"), "cluster")


def eps_edges(vecs: DataFrame, eps: float = 0.3, col: str = "vec", block: int | None = None,
              forest: bool = False) -> DataFrame:
    """Pairs (a < b) of unit vectors with cosine distance ``<= eps``; with ``forest`` only
    pairs that connect the same points, at most one a point and pair of blocks.  ``block``:
    about this many points a block."""
    size = vecs.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(col)).alias("d")).first()
    blocks = -(-size["n"] // block) if block else V.block_count(size["n"], size["d"] or 1, V.tasks_of(vecs))
    blocks = max(blocks, 1)
    return V.close_stars(stored(V.pack(vecs, blocks, col=col), "unit-blocks"), blocks, 1 - eps, forest)


def eps_clusters(vecs: DataFrame, eps: float = 0.3, col: str = "vec") -> DataFrame:
    """Cosine-eps graph components; a point without neighbours is its own cluster, and
    so is a zero vector, which has no direction.
    ``cluster`` = dense index of the component ordered by its smallest id."""
    unit = stored(normalise(vecs.select("token_id", F.col(col).alias("vec"))), "unit")
    directed = unit.filter(~F.exists("vec", lambda x: x.isNull()))
    edges = stored(eps_edges(directed, eps, forest=True), "eps-stars")
    ids = unit.select("token_id")
    if edges.isEmpty():
        dense = with_row_number(ids, [F.col("token_id").asc()], name="_c")
        return dense.select("token_id", (F.col("_c") - 1).cast("int").alias("cluster"))
    # only points with a neighbour need propagation
    linked = edges.select(F.explode(F.array("a", "b")).alias("token_id")).distinct()
    comp = connected_components(linked, edges)
    full = ids.join(comp, "token_id", "left").withColumn("component", F.coalesce("component", "token_id"))
    firsts = full.filter(F.col("component") == F.col("token_id")).select("component")
    dense = with_row_number(firsts, [F.col("component").asc()], name="_c")
    return full.join(dense, "component").select("token_id", (F.col("_c") - 1).cast("int").alias("cluster"))


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Min-label propagation with pointer jumping: ``(token_id, component)`` = smallest id reachable.

    Each round a node takes the least label of its neighbours and then the label of that
    label, so labels travel ever longer ways and a chain needs a logarithmic number of
    rounds.  Runs until nothing changes; one checkpoint per round keeps the plan short."""
    und = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    und = checkpoint_once(und)  # read every round
    lab = checkpoint_once(nodes.select("token_id", F.col("token_id").alias("component")))
    while True:
        # hook: a neighbour's least label lowers the label of the node and of its root
        seen = und.join(lab.withColumnRenamed("token_id", "b"), "b").groupBy("a").agg(F.min("component").alias("_m"))
        near = (lab.join(seen.withColumnRenamed("a", "token_id"), "token_id", "left")
                   .select("token_id", "component", F.least("component", F.coalesce("_m", "component")).alias("_m")))
        roots = near.groupBy("component").agg(F.min("_m").alias("_r")).withColumnRenamed("component", "token_id")
        hooked = checkpoint_once(near.join(roots, "token_id", "left").select(
            "token_id", "component", F.least("_m", F.coalesce("_r", "_m")).alias("_m")))
        # jump: take the label of the label
        up = hooked.select(F.col("token_id").alias("_m"), F.col("_m").alias("_j"))
        new = checkpoint_once(hooked.join(up, "_m").select(
            "token_id", F.col("_j").alias("component"), (F.col("_j") < F.col("component")).alias("_chg")))
        changed = int(scalar(new, F.sum(F.col("_chg").cast("int"))) or 0)
        lab = new.drop("_chg")
        if changed == 0:
            return lab


def eps_edges(vecs: DataFrame, eps: float = 0.3, col: str = "vec", block: int | None = None,
              forest: bool = False) -> DataFrame:
    """Pairs (a < b) of unit vectors with cosine distance ``<= eps``; with ``forest`` only
    pairs that connect the same points, at most one a point and pair of blocks.  ``block``:
    about this many points a block."""
    size = vecs.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(col)).alias("d")).first()
    blocks = -(-size["n"] // block) if block else V.block_count(size["n"], size["d"] or 1, V.tasks_of(vecs))
    blocks = max(blocks, 1)
    return V.close_stars(stored(V.pack(vecs, blocks, col=col), "unit-blocks"), blocks, 1 - eps, forest)


def eps_clusters(vecs: DataFrame, eps: float = 0.3, col: str = "vec") -> DataFrame:
    """Cosine-eps graph components; a point without neighbours is its own cluster, and
    so is a zero vector, which has no direction.
    ``cluster`` = dense index of the component ordered by its smallest id."""
    unit = normalise(vecs, col)
    directed = unit.filter(~F.exists(col, lambda x: x.isNull()))
    comp = connected_components(unit.select("token_id"), eps_edges(directed, eps, col, forest=True))
    firsts = comp.select("component").distinct()
    dense = with_row_number(firsts, [F.col("component").asc()], name="_c")
    return comp.join(dense, "component").select("token_id", (F.col("_c") - 1).cast("int").alias("cluster"))


def split_clusters(labels: DataFrame, vecs: DataFrame, n: int, seed: int = 42, rounds: int = 5,
                   col: str = "vec") -> DataFrame:
    """Grow ``labels (token_id, cluster)`` to ``n`` clusters by repeatedly
    splitting the largest clusters (size, then id, descending) with 2-means.

    All clusters chosen in a round are split in one job keyed by cluster id:
    each has two centres (its two smallest ``md5(seed:token_id)`` members), so the
    centre table is bounded by twice the number of splits.  The second half of
    the i-th split gets id ``max + 1 + i``.
    """
    lab = checkpoint_once(labels.select("token_id", "cluster").join(vecs.select("token_id", col), "token_id"))
    while True:  # ends when there are enough clusters or none can be split
        sizes = lab.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
        current = int(scalar(sizes, F.count(F.lit(1))))
        if current >= n:
            break
        splittable = sizes.filter(F.col("size") >= 2)
        r = with_row_number(splittable, [F.col("size").desc(), F.col("cluster").desc()], name="_o")
        chosen = r.filter(F.col("_o") <= n - current).select("cluster", "_o")
        if scalar(chosen, F.count(F.lit(1))) == 0:
            break
        top = int(scalar(lab, F.max("cluster")))
        pts = lab.join(chosen, "cluster")
        h = F.md5(F.concat(F.lit(f"{seed}:"), F.col("token_id").cast("string")))
        init = with_row_number(pts.withColumn("_h", h), [F.col("_h").asc(), F.col("token_id").asc()],
                               name="_r", groups=["cluster"])
        cents = init.filter(F.col("_r") <= 2).select("cluster", (F.col("_r") - 1).alias("sub"),
                                                     F.col(col).alias("centre"))
        for _ in range(rounds + 1):
            d = pts.join(cents, "cluster").withColumn("_d", sq_dist(F.col(col), F.col("centre")))
            best = d.groupBy("token_id", "cluster").agg(F.min_by("sub", F.struct("_d", "sub")).alias("sub"))
            assigned = pts.join(best, ["token_id", "cluster"])
            halves = assigned.withColumn("_key", F.col("cluster").cast("long") * 2 + F.col("sub"))
            new = mean_vectors(halves, col, key="_key").select(
                F.floor(F.col("_key") / 2).cast("int").alias("cluster"), F.pmod("_key", F.lit(2)).cast("int").alias("sub"), "centre")
            cents = checkpoint_once(
                new.unionByName(cents.join(new.select("cluster", "sub"), ["cluster", "sub"], "left_anti")))
        moved = assigned.select("token_id", F.when(F.col("sub") == 1, F.lit(top) + F.col("_o")).otherwise(F.col("cluster"))
                                .cast("int").alias("cluster"), col)
        lab = checkpoint_once(lab.join(chosen.select("cluster"), "cluster", "left_anti").unionByName(
            moved.select("token_id", "cluster", col)).select("token_id", "cluster", col))
    return lab.select("token_id", "cluster")
