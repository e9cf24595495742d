"""Approximate nearest neighbours on shifted space-filling curves.

Every vector is projected ``CURVES`` times to a few dimensions with other
rotations and shifts, and ordered along a Hilbert curve each time.  Spark range-
partitions all orderings by (curve, key); ranks along a curve are cut into
cells.  A query looks into the cells around its own rank on each curve; what
the windows find is merged and reranked by exact inner products.

For inner products of vectors of any length, candidates get one more component
that brings all to the greatest length, and queries are scaled to it (Bachrach
et al., 2014): the largest product is then the smallest distance.

How far a window must reach depends on the data and the table's size, so it is
measured on the table: ``PROBES`` queries are searched by brute force over all
rows, and the reach is the one that finds ``GOAL`` of their true neighbours.  On
vectors without any structure that is a large part of a curve, as for every
index; cells stay of one size, and only their number for each query grows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch
from .workers import trimmed, trimmed_group

CURVES, DIMS, BITS, SAMPLE, PROBES, GOAL = 6, 6, 8, 4000, 100, 0.96
#: Rows of a curve that are searched together, and queries that do so at once.
CELL, QUERIES = 2048, 4096


class Curves:
    """Projections, shifts and scales of all orderings."""

    def __init__(self, sample, longest: float, seed: int = 11):
        import numpy as np

        rng = np.random.Generator(np.random.PCG64(seed))
        d = sample.shape[1] + 1
        self.longest = longest
        self.rotations = [np.linalg.qr(rng.normal(size=(d, d)))[0][:, : min(DIMS, d)] for _ in range(CURVES)]
        self.shifts = [rng.random(r.shape[1]) for r in self.rotations]
        lifted = self.lift(sample, False)
        self.marks = [np.quantile(lifted @ r, np.linspace(0, 1, 65), axis=0) for r in self.rotations]

    def lift(self, x, query: bool):
        import numpy as np

        if query:
            return np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))])
        x = x / self.longest
        return np.hstack([x, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1, keepdims=True)))])

    def keys(self, x, query: bool):
        """A key for each curve (rows) and vector (columns)."""
        import numpy as np

        lifted = self.lift(x, query)
        out = []
        for rotation, shift, marks in zip(self.rotations, self.shifts, self.marks):
            y = lifted @ rotation
            u = np.stack([np.interp(y[:, k], marks[:, k], np.linspace(0, 1, 65)) for k in range(y.shape[1])], axis=1)
            out.append(hilbert(np.minimum(((u + shift) / 2 * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS))
        return np.stack(out)


def hilbert(x, bits: int):
    """Position along a Hilbert curve of points with coordinates of ``bits`` bits (Skilling's transform)."""
    import numpy as np

    x = x.copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            set_ = (x[:, i] & q) != 0
            t = (x[:, 0] ^ x[:, i]) & p
            x[:, 0] ^= np.where(set_, p, t)
            x[:, i] ^= np.where(set_, 0, t)
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[:, n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def _brute(probes, ids, k: int):
    """Running top ``k`` of every probe over a partition's rows, by inner product."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        best = [(np.zeros(0), np.zeros(0, np.int64))] * len(ids)
        for batch in batches:
            rows = batch.column(0).to_numpy()
            x = np.array(batch.column(1).to_pylist(), np.float64)
            if not len(rows):
                continue
            s = probes @ x.T
            s[ids[:, None] == rows[None, :]] = -np.inf  # a probe isn't its own neighbour
            for q in range(len(ids)):
                score, row = np.concatenate([best[q][0], s[q]]), np.concatenate([best[q][1], rows])
                keep = np.lexsort((row, -score))[:k]
                best[q] = (score[keep], row[keep])
        out = [(int(i), r, v) for i, (score, row) in zip(ids, best) for v, r in zip(score.tolist(), row.tolist()) if v > -np.inf]
        yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    return run


def _reach(rows: DataFrame, ranked: DataFrame, k: int, step: int) -> int:
    """How far along a curve a window must reach, so that ``GOAL`` of the true neighbours of ``PROBES`` queries lie in one."""
    import numpy as np

    probes = rows.where(F.pmod("vec_id", F.lit(step)) == 0).orderBy(F.xxhash64("vec_id")).limit(PROBES).collect()
    if not probes:
        return 0
    ids = np.array([r["vec_id"] for r in probes], np.int64)
    near = rows.mapInArrow(trimmed(_brute(np.array([r["v"] for r in probes], np.float64), ids, k)), "query_id long, vec_id long, score double")
    turn = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    true = near.withColumn("t", F.row_number().over(turn)).where(F.col("t") <= k).select("query_id", "vec_id").collect()  # PROBES times k rows
    wanted = sorted({int(i) for i in ids} | {r["vec_id"] for r in true})
    place: dict[tuple, int] = {}
    for r in ranked.where(F.col("vec_id").isin(wanted)).select("curve", "vec_id", "query", "rank").collect():
        place[r["curve"], r["vec_id"], r["query"]] = r["rank"]
    gaps = [min(abs(place[c, r["query_id"], True] - place[c, r["vec_id"], False]) for c in range(CURVES)) for r in true]
    return int(np.ceil(np.quantile(gaps, GOAL))) if gaps else 0


def _keyed(curves: Curves, step: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ids = np.array(batch.column(0).to_pylist(), np.int64)
            x = np.array(batch.column(1).to_pylist(), np.float64)
            if not len(ids):
                continue
            for query in (False, True):
                pick = ids % step == 0 if query else np.ones(len(ids), bool)
                if not pick.any():
                    continue
                keys = curves.keys(x[pick], query)
                vectors = batch.column(1).filter(pa.array(pick))
                for c in range(CURVES):
                    n = int(pick.sum())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, c, np.int32)), pa.array(keys[c]), pa.array(ids[pick]), pa.array(np.full(n, query)), vectors],
                        names=["curve", "key", "vec_id", "query", "v"],
                    )

    return run


def _search(k: int):
    def run(table):
        import numpy as np
        import pyarrow as pa

        query = np.array(table.column("query").to_pylist(), bool)
        ids = table.column("vec_id").to_numpy()
        flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        x = flat.reshape(len(ids), -1)
        qi, ci, q, c = ids[query], ids[~query], x[query], x[~query]
        found = []
        if len(ci):
            for a in range(0, len(qi), 256):
                s = q[a : a + 256] @ c.T
                s[qi[a : a + 256, None] == ci[None, :]] = -np.inf
                m = min(len(ci), k + 12)
                edge = np.partition(s, len(ci) - m, axis=1)[:, len(ci) - m] - 1e-9
                for r in range(len(s)):
                    near = np.flatnonzero((s[r] >= edge[r]) & np.isfinite(s[r]))
                    exact = (c[near] * q[a + r]).sum(axis=1)  # the same order of additions for every pair
                    order = np.lexsort((ci[near], -exact))[:k]
                    found.append((int(qi[a + r]), exact[order], ci[near][order]))
        kind = pa.list_(pa.struct([("far", pa.float64()), ("vec_id", pa.int64())]))
        hits = [[{"far": -s, "vec_id": i} for s, i in zip(f[1].tolist(), f[2].tolist())] for f in found]
        return pa.table({"query_id": pa.array([f[0] for f in found], pa.int64()), "hits": pa.array(hits, kind)})

    return run


def nearest(vectors: DataFrame, k: int = 20, step: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` for every row whose id is divisible by ``step``.

    The ``k`` rows of largest inner product that the windows hold, nearest first,
    ties to the smaller id; the query's own row isn't one of them.  Rows with a
    null id, and vectors that are null, zero, hold null or non-finite components
    or have another length than most, take no part.  Equal vectors compete by
    id, so only the ``k + 1`` smallest ids of each can be a neighbour and are
    indexed; rows that repeat an id count once.  Every query gets ``k`` rows, or all
    candidates if there are fewer.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    v = F.col(vector_col).cast("array<double>")
    limit = 1.7976931348623157e308
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= limit)) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    dims = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "d").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not dims:
        return empty
    rows = rows.where(F.size("v") == dims[0]["d"]).groupBy("vec_id").agg(F.min("v").alias("v"))
    rows = scratch.save(rows, "rows")
    turn = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    kept = rows.withColumn("_turn", turn).where(F.col("_turn") <= k + 1).drop("_turn")
    extra = rows.where(F.pmod("vec_id", F.lit(step)) == 0)  # queries stay, whatever their turn
    rows = scratch.save(kept.unionByName(extra).distinct(), "kept")

    import numpy as np

    total, longest = rows.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()
    picked = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < max(1, int((1 << 20) * min(1.0, 2.0 * SAMPLE / total)))).orderBy(F.xxhash64("vec_id")).limit(SAMPLE).collect()
    sample = np.array([r["v"] for r in picked], np.float64) if picked else np.array([rows.first()["v"]], np.float64)
    curves = Curves(sample, longest)

    keyed = rows.mapInArrow(trimmed(_keyed(curves, step)), "curve int, key long, vec_id long, query boolean, v array<double>")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = keyed.repartitionByRange(parts, "curve", "key", "vec_id").sortWithinPartitions("curve", "key", "vec_id", "query")
    mono = F.monotonically_increasing_id()
    ordered = scratch.save(order.withColumn("part", F.shiftright(mono, 33)).withColumn("pos", mono.bitwiseAND(F.lit((1 << 33) - 1))), "ordered")
    counts = ordered.groupBy("curve", "part").agg(F.count("*").alias("n"), F.min("pos").alias("first")).orderBy("curve", "part").collect()  # a row for each partition and curve
    base, sizes = {}, {}
    for r in counts:
        base[r["curve"], r["part"]] = sizes.get(r["curve"], 0) - r["first"]
        sizes[r["curve"]] = sizes.get(r["curve"], 0) + r["n"]
    starts = spark.createDataFrame([(c, p, o) for (c, p), o in base.items()], "curve int, part long, base long")
    ranked = ordered.join(F.broadcast(starts), ["curve", "part"]).withColumn("rank", F.col("pos") + F.col("base"))
    reach, most = max(k + 1, _reach(rows, ranked, k, step)), max(sizes.values())
    while True:
        found = scratch.save(_windows(ranked, scratch, reach, most, k), f"found-{reach}")
        # A window may hold few candidates among many queries: then all look further.
        full = found.where(F.size("hits") >= min(k, total - 1)).count()
        if reach >= most or full == found.count() == rows.where(F.pmod("vec_id", F.lit(step)) == 0).count():
            break
        reach *= 4
    return found.select("query_id", F.posexplode("hits").alias("p", "h")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("h.vec_id").alias("vec_id"), (-F.col("h.far")).alias("score"))


def _windows(ranked: DataFrame, scratch: Scratch, reach: int, most: int, k: int) -> DataFrame:
    """``query_id, hits``: the best of all cells within ``reach`` of a query on any curve.

    A cell holds ``CELL`` consecutive rows of a curve; where more than
    ``QUERIES`` queries look into one, they are dealt over copies of it, so no
    group grows with the table.
    """
    own, last = F.floor(F.col("rank") / CELL).cast("int"), (most - 1) // CELL
    low, high = F.greatest(F.lit(0), F.floor((F.col("rank") - reach) / CELL)).cast("int"), F.least(F.lit(last), F.floor((F.col("rank") + reach) / CELL)).cast("int")
    cells = ranked.where("not query").withColumn("cell", own)
    asked = ranked.where("query").withColumn("cell", F.explode(F.sequence(low, high)))
    busy = asked.groupBy("curve", "cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("copies")).where("copies > 1")
    busy = scratch.save(busy, f"busy-{reach}")
    if busy.isEmpty():
        cells, asked = cells.withColumn("copy", F.lit(0)), asked.withColumn("copy", F.lit(0))
    else:
        copies = F.coalesce("copies", F.lit(1))
        cells = cells.join(busy, ["curve", "cell"], "left").withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))
        asked = asked.join(busy, ["curve", "cell"], "left").withColumn("copy", F.pmod(F.xxhash64("vec_id"), copies).cast("int"))
    names = ["curve", "cell", "copy", "vec_id", "query", "v"]
    met = cells.select(*names).unionByName(asked.select(*names)).groupBy("curve", "cell", "copy")
    found = met.applyInArrow(trimmed_group(_search(k)), "query_id long, hits array<struct<far:double,vec_id:long>>")
    merged = found.groupBy("query_id").agg(F.sort_array(F.flatten(F.collect_list("hits"))).alias("hits"))
    # A row found twice has one score, so its copies are neighbours.
    best = F.expr(f"transform(array(hits), a -> slice(filter(a, (x, i) -> i = 0 or x.vec_id <> a[i - 1].vec_id), 1, {k}))[0]")
    return merged.select("query_id", best.alias("hits"))
