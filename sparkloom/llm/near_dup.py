"""Near-duplicate documents by bottom-k sketches.

One hash function orders all shingles.  A document keeps its ``SKETCH`` smallest
hashes; the inverted lists of retained values propose pairs, the sketch of a
pair's union estimates its similarity, and pairs that may reach the threshold
are confirmed on their full shingle sets.

Two sets at the threshold share each of the smallest values of their union with
that probability, so the values that two sketches share follow a binomial
distribution at worst; ``least_shared`` is the number that is reached except
with a probability of ``MISS``, which is far smaller for closer pairs.  With
``sketch=None`` sketches are whole sets and no pair is missed.  By the
prefix-filter principle it is enough to index the rarest retained values of each
document, so many that two similar documents must meet in one.  Passages that
many documents share are seldom among the rarest, so their lists stay short.

A list proposes pairs with its centres: all of its documents if they are few,
else about ``STARS`` of them, whom all others meet.  So a list of near copies
costs pairs in proportion to its length, and most of it is one component
afterwards.  Where a list still spans several components, only pairs between
them matter.  Lists that share documents form a group; the documents outside its
largest component, in blocks of about ``BLOCK``, meet blocks of all its
documents, two blocks to a task, and only links that connect something new leave
it.  Nothing is dropped: a pair goes unseen only if both are connected already.
Documents with equal sets are one class from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch
from .workers import trimmed, trimmed_group

SKETCH, MISS = 64, 1e-6
#: Lists of up to ``FEW`` documents propose all pairs, longer ones those with ``STARS`` centres.
FEW, STARS, BLOCK = 16, 4, 256
#: Shingles of the documents that a worker remembers while it confirms pairs.
REMEMBERED = 2_000_000


def _sketcher(width: int, sketch: int | None):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        from .texthash import as_bytes, pieces, shingle_sets

        for batch in batches:
            texts = as_bytes(batch.column(1))
            for a, b in pieces(texts):
                sets = shingle_sets(texts[a:b], width)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a).cast(pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array([s[:sketch].view(np.int64) for s in sets], pa.list_(pa.int64())),
                        batch.column(2).slice(a, b - a),
                    ],
                    names=["doc_id", "n", "fp", "sketch", "text_hash"],
                )

    return run


def _verifier(width: int, percent: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .texthash import as_bytes, shingle_sets

        known: dict = {}
        held = 0

        def sets(ids, texts):
            nonlocal held
            miss = {i: t for i, t in zip(ids, texts) if i not in known}
            new = shingle_sets(list(miss.values()), width)
            known.update(zip(miss, new))
            held += sum(map(len, new))

        for batch in batches:
            left, right = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            lt, rt = as_bytes(batch.column(2)), as_bytes(batch.column(3))
            keep = np.zeros(len(left), bool)
            for at in range(0, len(left), 256):
                if held > REMEMBERED:
                    known.clear()
                    held = 0
                part = slice(at, at + 256)
                sets(left[part], lt[part])
                sets(right[part], rt[part])
                for k in range(at, min(at + 256, len(left))):
                    x, y = known[left[k]], known[right[k]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[k] = both > 0 and 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"])

    return run


def _block_links(width: int, percent: int):
    """Links of one block's documents (``asks``) with another's of other components, reduced to a spanning forest."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        from .texthash import as_bytes, pieces, shingle_sets

        rows = {}
        asks, told = [], []
        for i, t, c, a in zip(table.column("rep").to_pylist(), as_bytes(table.column("text").combine_chunks()), table.column("c").to_pylist(), table.column("asks").to_pylist()):
            rows[i] = (t, c)
            (asks if a else told).append(i)
        ids = np.array(sorted(rows), np.int64)
        texts, part = [rows[i][0] for i in ids.tolist()], np.array([rows[i][1] for i in ids.tolist()])
        left, right = np.searchsorted(ids, sorted(asks)), np.searchsorted(ids, sorted(told))
        sets: list = []
        for a, b in pieces(texts):
            sets += shingle_sets(texts[a:b], width)
        size = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), size)
        value, held = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)[1:]
        shared = held[value] > 1
        owner, value = owner[shared], value[shared]
        order = np.argsort(value, kind="stable")
        owner, value = owner[order], value[order]
        both = np.zeros((len(left), len(right)), np.float64)
        at = 0
        while at < len(value):  # a slice of about 4096 distinct values at a time
            end = int(np.searchsorted(value, value[at] + 4096))
            _, column = np.unique(value[at:end], return_inverse=True)
            dense = np.zeros((len(sets), int(column.max()) + 1), np.float32)
            dense[owner[at:end], column] = 1
            both += dense[left] @ dense[right].T
            at = end
        linked = (both > 0) & (100 * both >= percent * (size[left][:, None] + size[right][None, :] - both)) & (part[left][:, None] != part[right][None, :])
        # A forest over the components that are known already and the new links between them.
        names, part = np.unique(part, return_inverse=True)
        root, edges = list(range(len(names))), []

        def find(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for k, j in zip(*np.nonzero(linked)):
            x, y = find(int(part[left[k]])), find(int(part[right[j]]))
            if x != y:
                root[x] = y
                edges.append((int(ids[left[k]]), int(ids[right[j]])))
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    return run


def least_shared(sketch: int, percent: int, miss: float) -> int:
    """The most values that two sketches of similar sets share, but for a probability below ``miss``.

    Each of the ``sketch`` smallest values of the union is in both sets with a
    probability of at least ``percent`` hundredths.
    """
    from math import comb

    p, below = percent / 100.0, 0.0
    for m in range(sketch + 1):
        below += comb(sketch, m) * p**m * (1 - p) ** (sketch - m)
        if below > miss:
            return m
    return sketch


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, sketch: int | None = SKETCH) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Links documents whose shingle sets of ``width`` words have a similarity of at
    least ``percent`` hundredths; ``component_id`` is the smallest id reachable.
    Null and empty texts, and texts of white space only, have ``n_shingles`` 0
    and stand alone.  Equal texts are always linked.  A row with a null id has
    its set counted, links nothing, gets a null ``component_id`` and is kept.
    Rows that repeat an id are judged by their own text and all returned.  Other
    columns of ``docs`` are ignored.  A link is missed with a probability of
    ``MISS`` at most, and never with ``sketch=None``, which indexes whole sets.
    """
    return judge(docs, id_col, text_col, width, percent, sketch).select("doc_id", "n_shingles", "component_id", "kept")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, sketch: int | None = SKETCH) -> DataFrame:
    """``near_duplicates`` with two more columns, since an id may stand for several texts.

    ``text_hash`` is the ``xxhash64`` of the row's text; ``group_key`` names the
    component itself, and is null for texts without shingles and rows without id.
    """
    spark = docs.sparkSession
    if not 0 < percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    shared = least_shared(sketch, percent, MISS) if sketch else 0
    if sketch and not shared:
        raise ValueError(f"sketches of {sketch} values can't find pairs of {percent} %: take more, or None")
    scratch = Scratch(spark, "neardup")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    raw = scratch.save(docs.mapInArrow(trimmed(_sketcher(width, sketch)), "doc_id long, n long, fp binary, sketch array<long>, text_hash long"), "raw")
    first = raw.where("fp is not null and doc_id is not null").groupBy("fp").agg(F.min(F.struct("doc_id", "text_hash", "n", "sketch")).alias("r"))
    # A class is named by its fingerprint, not by an id: an id may have several texts.
    classes = scratch.save(first.select("fp", F.xxhash64("fp").alias("rep"), F.col("r.doc_id").alias("least_id"), "r.text_hash", "r.n", "r.sketch"), "classes")

    # Retained values that at least two classes hold, with how many hold them.
    held = classes.select("rep", "n", F.explode("sketch").alias("v"))
    # Saved first: a join of two plain shuffles can split a very common value over tasks.
    df = scratch.save(held.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"), "df")
    common = held.join(df, "v")
    bound = sketch or (1 << 31) - 1  # what a whole set never reaches
    kept_values = F.least("n", F.lit(bound)).cast("int")
    # Similar sets share a part of the smaller one; both sketches are whole sets below the bound.
    least = F.ceil(F.col("n") * (percent / 100.0) - 1e-9)
    if sketch:
        least = F.when(F.col("n") >= sketch, F.lit(shared)).otherwise(F.least(least, F.lit(least_shared(sketch, percent, MISS))))
    budget = (kept_values - least + 1).cast("int")
    # Values of one class only come first among the rarest; they need no row here.
    by_doc = common.groupBy("rep").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"))
    left = F.greatest(F.lit(0), F.least(F.size("vs"), budget - (kept_values - F.size("vs"))))
    keys = by_doc.select("rep", "n", F.explode(F.slice("vs", F.lit(1), left)).alias("k")).select("rep", "n", F.col("k.v").alias("v"))
    keys = scratch.save(keys, "keys")
    sa = classes.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    sb = classes.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    top = "9223372036854775807L"
    unsigned = "(x ^ (-9223372036854775807L - 1L))"  # hashes are ordered as unsigned
    last = f"least(if(na < {bound}, {top}, transform(slice(sa, -1, 1), x -> {unsigned})[0]), if(nb < {bound}, {top}, transform(slice(sb, -1, 1), x -> {unsigned})[0]))"
    whole = (F.col("na") < bound) & (F.col("nb") < bound)
    likely = F.when(whole, 100 * F.col("i") >= percent * F.col("u")).otherwise(F.col("i") * bound >= F.col("u") * shared)

    def texts_of(reps: DataFrame, label: str) -> DataFrame:
        """``rep, text``: of each class, the text that made it."""
        made = classes.join(reps.distinct(), "rep", "left_semi").select("rep", F.col("least_id").alias("doc_id"), "text_hash")
        return scratch.save(docs.join(made, ["doc_id", "text_hash"]).select("rep", "text").dropDuplicates(["rep"]), label)

    # Pairs with centres: estimated by the union's sketch, confirmed on full sets.
    lists = scratch.save(keys.groupBy("v").agg(F.count("*").alias("m")).where("m > 1"), "lists")
    chance = F.pmod(F.xxhash64("rep", F.lit(0)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    centre = (F.col("m") <= FEW) | (chance * F.col("m") < STARS)
    # Saved: a join of two plain shuffles can split a list that holds very many documents.
    listed = scratch.save(keys.join(lists, "v").select("v", "rep", "n", "m", centre.alias("centre")), "listed")
    other = listed.where("centre").select("v", F.col("rep").alias("b"), F.col("n").alias("nb"))
    near = (100 * F.least("n", "nb") >= percent * F.greatest("n", "nb")) & (F.col("rep") != F.col("b")) & (~F.col("centre") | (F.col("rep") < F.col("b")))
    pairs = listed.join(other, "v").where(near).select(F.least("rep", "b").alias("a"), F.greatest("rep", "b").alias("b")).distinct()
    estimate = pairs.join(sa, "a").join(sb, "b").withColumn("last", F.expr(last))
    estimate = estimate.withColumn("i", F.expr(f"size(filter(array_intersect(sa, sb), x -> {unsigned} <= last))"))
    estimate = estimate.withColumn("u", F.expr(f"size(filter(array_union(sa, sb), x -> {unsigned} <= last))"))
    likely = scratch.save(estimate.where(likely).select("a", "b"), "likely")
    texts = texts_of(likely.select(F.col("a").alias("rep")).unionByName(likely.select(F.col("b").alias("rep"))), "texts")
    ta, tb = texts.select(F.col("rep").alias("a"), F.col("text").alias("ta")), texts.select(F.col("rep").alias("b"), F.col("text").alias("tb"))
    sure = likely.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb").mapInArrow(trimmed(_verifier(width, percent)), "a long, b long")
    links = scratch.save(sure, "links")
    scratch.drop("texts")

    # Long lists that still span several components.
    joined = scratch.save(connected_components(links, scratch, "stars"), "joined")
    left_in = listed.where(f"m > {FEW} and not centre").join(joined, F.col("rep") == F.col("node"), "left").select("v", "rep", F.coalesce("component", "rep").alias("c"))
    left_in = scratch.save(left_in, "left")
    spans = left_in.groupBy("v").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("v")
    left_in = scratch.save(left_in.join(scratch.save(spans, "spans"), "v"), "open")
    if not left_in.isEmpty():
        home = left_in.groupBy("rep").agg(F.min("v").alias("home"), F.first("c").alias("c"))
        ties = left_in.join(home.select("rep", "home"), "rep").where("v <> home").select(F.col("v").alias("x"), "home").distinct()
        tied = connected_components(ties, scratch, "hotlists")
        members = home.join(tied, F.col("home") == F.col("node"), "left").select("rep", "c", F.coalesce("component", "home").alias("g"))
        members = scratch.save(members, "members")
        sizes = members.groupBy("g", "c").agg(F.count("*").alias("z")).groupBy("g").agg(F.max(F.struct("z", "c")).alias("most"), F.sum("z").alias("m"))
        outside = F.ceil((F.col("m") - F.col("most.z")) / BLOCK).cast("int")
        sizes = scratch.save(sizes.select("g", F.col("most.c").alias("most"), outside.alias("askers"), F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")).where("askers > 0"), "sizes")
        placed = scratch.save(members.join(sizes, "g").join(texts_of(members.select("rep"), "grouped-texts"), "rep"), "placed")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        place = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
        told = placed.select("g", each("askers").alias("x"), place("blocks").alias("y"), "rep", "c", "text", F.lit(False).alias("asks"))
        asked = placed.where("c <> most").select("g", place("askers").alias("x"), each("blocks").alias("y"), "rep", "c", "text", F.lit(True).alias("asks"))
        inside = told.unionByName(asked).groupBy("g", "x", "y").applyInArrow(trimmed_group(_block_links(width, percent)), "a long, b long")
        links = links.unionByName(scratch.save(inside, "inside"))
        joined = connected_components(links, scratch)

    grouped = classes.select("fp", "rep", "least_id").join(joined, F.col("rep") == F.col("node"), "left").select("fp", "least_id", F.coalesce("component", "rep").alias("group_key"))
    grouped = scratch.save(grouped, "grouped")
    least_ids = scratch.save(grouped.groupBy("group_key").agg(F.min("least_id").alias("c")), "least")
    out = raw.select("doc_id", "n", "fp", "text_hash").join(grouped.join(least_ids, "group_key").select("fp", "group_key", "c"), "fp", "left")
    named = F.col("doc_id").isNotNull()
    cid = F.when(named, F.coalesce("c", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == cid, F.lit(True))
    return out.select("doc_id", F.col("n").alias("n_shingles"), cid.alias("component_id"), kept.alias("kept"), "text_hash", F.when(named, F.col("group_key")).alias("group_key"))
