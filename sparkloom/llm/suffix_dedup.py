"""Removal of long strings that occur more than once in a corpus.

In every window of ``min_bytes`` the suffix with the smallest fingerprint of its
first ``GRAM`` bytes is sampled, so equal windows sample the same suffix, and a
sampled suffix stands for a run of neighbouring windows.  Suffixes whose first
``GRAM`` bytes occur once only can't belong to a repeated window and go; runs
whose whole bytes occur again are settled.

The other suffixes, one for each kind of run, enter ``SuffixIndexFamily``: every
batch gets its suffix array, a table of suffixes in order of their bytes, which
is merge-scanned with each level of earlier batches.  Neighbours in a merged
order share the longest beginnings, so the scan tells how far any other suffix
agrees with each.  Two levels of equal size merge into one of the next.  A
window that reaches beyond the longest match of its suffix occurs once only.

What is left stands at the ends of matches, where text before the suffix decides
too.  Windows are dealt into bins; bins whose shared bytes occur elsewhere have
each window compared.  All counts are pre-aggregated, so no passage, however
common, meets in one task.  Where fingerprints decide, two of 64 bits must agree.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .workers import trimmed

GRAM, STEP, SEGMENT = 64, 16, 1 << 20
_RAW = "doc_id long, tk long, n_bytes long, sha string, suffixes array<struct<k1:long,k2:long,p:int,s:int,e:int>>"


def _sampler(width: int):
    def sample(np, buf, bounds):
        """Sampled suffixes of the texts in ``buf``: k1, k2, place, first and last window."""
        from .texthash import RollingHash, mix

        span = width - GRAM + 1
        rolling = RollingHash(buf)
        gram = rolling.windows(GRAM)
        n = len(gram) - span + 1
        if n <= 0:
            return None
        value = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
        padded = np.full(-(-len(value) // span) * span, np.uint64(0xFFFFFFFFFFFFFFFF))
        padded[: len(value)] = value
        grid = padded.reshape(-1, span)
        before = np.minimum.accumulate(grid, axis=1).ravel()
        after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(after[:n], before[span - 1 : span - 1 + n])
        lengths = np.diff(bounds) - width + 1  # windows of each text
        inside = np.zeros(n + 1, np.int32)
        for a, m in zip(bounds[:-1].tolist(), lengths.tolist()):
            if m > 0:
                inside[a] += 1
                inside[a + m] -= 1
        at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
        if not len(at):
            return None
        anchor = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        cut = np.flatnonzero(np.diff(anchor)) + 1
        lo = at[np.concatenate([[0], cut])]
        hi = at[np.concatenate([cut - 1, [len(at) - 1]])]
        a = anchor[np.concatenate([[0], cut])]
        shape = mix(((a - lo) * 65536 + (hi - lo)).astype(np.uint64))
        return gram[a], mix(rolling.slices(lo, hi + width) ^ shape), a, lo, hi

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import numpy as np
        import pyarrow as pa

        from .texthash import as_bytes, pieces

        for batch in batches:
            texts = as_bytes(batch.column(2))
            parts = []  # (text's number, offset, bytes): long texts in overlapping segments
            for k, t in enumerate(texts):
                parts += [(k, o, t[o : o + SEGMENT + width - 1]) for o in range(0, max(1, len(t) - width + 1), SEGMENT)]
            count = np.zeros(len(texts), np.int64)
            found: list[tuple] = []
            for x, y in pieces([p[2] for p in parts], SEGMENT):
                bounds = np.cumsum([0] + [len(p[2]) for p in parts[x:y]])
                got = sample(np, np.frombuffer(b"".join(p[2] for p in parts[x:y]), np.uint8), bounds)
                if got is None:
                    continue
                k1, k2, at, lo, hi = got
                part = np.searchsorted(bounds, lo, "right") - 1
                shift = np.array([p[1] for p in parts[x:y]])[part] - bounds[part]
                np.add.at(count, np.array([p[0] for p in parts[x:y]])[part], 1)
                found.append((k1.view(np.int64), k2.view(np.int64), (at + shift).astype(np.int32), (lo + shift).astype(np.int32), (hi + shift).astype(np.int32)))
            columns = [np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64 if c < 2 else np.int32) for c in range(5)]
            struct = pa.StructArray.from_arrays([pa.array(c) for c in columns], names=["k1", "k2", "p", "s", "e"])
            offsets = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                    pa.ListArray.from_arrays(offsets, struct),
                ],
                names=["doc_id", "tk", "n_bytes", "sha", "suffixes"],
            )

    return run


def _flat(lists, names):
    """The fields of a column of lists of structs as arrays, and the lists' bounds in them."""
    import numpy as np

    bounds = lists.offsets.to_numpy()
    values = lists.values
    return [values.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names], bounds


def _expand(np, first, last):
    """All integers of the ranges ``first`` to ``last``, and the number of the range of each."""
    length = last - first + 1
    number = np.repeat(np.arange(len(first)), length)
    return np.arange(len(number)) - np.repeat(np.cumsum(length) - length, length) + first[number], number


def _probe(width: int, cores: bool):
    """Fingerprints of parts of texts around the given suffixes.

    Windows are dealt into bins by how far before the suffix they start, ``STEP``
    to a bin.  With ``cores``, one row for each bin: the bytes that all its
    windows share, and the bytes that any of them covers.  Without, one row for
    each window of the given bins.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .texthash import RollingHash, as_bytes, mix

        names = ["w", "h", "tk", "n_bytes", "p", "lo", "hi"] if cores else ["w", "w2", "tk", "n_bytes", "p", "i"]
        out: list = []

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[c] for o in out])) for c in range(len(names))], names=names)

        rows = 0
        for batch in batches:
            key, size, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), as_bytes(batch.column(2))
            fields, bounds = _flat(batch.column(3), ("p", "s", "e") if cores else ("p", "lo", "hi"))
            for k, t in enumerate(texts):
                rolling = RollingHash(np.frombuffer(t, np.uint8))
                p, s, e = (f[bounds[k] : bounds[k + 1]] for f in fields)
                if cores:
                    j, of = _expand(np, (p - e) // STEP, (p - s) // STEP)
                    w = mix(rolling.slices(p[of] - STEP * j, p[of] - STEP * (j + 1) + 1 + width) ^ mix(j.astype(np.uint64)))
                    lo, hi = np.maximum(s[of], p[of] - STEP * (j + 1) + 1), np.minimum(e[of], p[of] - STEP * j)
                    shape = mix(((p[of] - lo) * 65536 + (hi - lo)).astype(np.uint64))
                    first = (w.view(np.int64), mix(rolling.slices(lo, hi + width) ^ shape).view(np.int64))
                    more = (p[of], lo, hi)
                else:
                    i, of = _expand(np, s, e)
                    w = mix(rolling.slices(i, i + width))
                    second = mix(RollingHash(np.frombuffer(t, np.uint8), 1).slices(i, i + width))
                    first, more = (w.view(np.int64), second.view(np.int64)), (p[of], i)
                out.append((*first, np.full(len(w), key[k]), np.full(len(w), size[k]), *more))
                rows += len(w)
                if rows >= 100_000:
                    yield batch_of()
                    out, rows = [], 0
        if out:
            yield batch_of()

    return run


def _merge(starts, ends) -> list[tuple[int, int]]:
    """Sorted disjoint spans that cover the same bytes."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts.tolist(), ends.tolist())):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]])


def _digest(batches: Iterator) -> Iterator:
    import hashlib

    import pyarrow as pa

    from .texthash import as_bytes

    for batch in batches:
        removed, runs, sha, merged = [], [], [], []
        (first, last), bounds = _flat(batch.column(3), ("a", "b"))
        for k, t in enumerate(as_bytes(batch.column(2))):
            m = _merge(first[bounds[k] : bounds[k + 1]], last[bounds[k] : bounds[k + 1]])
            removed.append(sum(b - a for a, b in m))
            runs.append(len(m))
            sha.append(hashlib.sha256(cut(t, m)).hexdigest())
            merged.append([{"a": a, "b": b} for a, b in m])
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha), pa.array(merged, kind)],
            names=["tk", "n_bytes", "n_removed", "n_spans", "kept_sha", "spans"],
        )


def _suffixes(width: int):
    """The bytes of the given suffixes, as far as their run's last window reaches."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .texthash import as_bytes

        fields = ("k1", "k2", "p", "s", "e")
        for batch in batches:
            values, bounds = _flat(batch.column(3), fields)
            for row, t in enumerate(as_bytes(batch.column(2))):
                part = slice(bounds[row], bounds[row + 1])
                p, e = values[2][part].tolist(), values[4][part].tolist()
                bytes_ = [t[x : y + width] for x, y in zip(p, e)]
                same = [pa.array(np.full(len(p), batch.column(c)[row].as_py())) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(bytes_, pa.binary()), *same, *(pa.array(v[part]) for v in values)], names=["suffix", "tk", "n_bytes", *fields])

    return run


def _common(np, suffixes: list[bytes]):
    """How many bytes each of some suffixes shares with the next."""
    size = np.array([len(x) for x in suffixes])
    grid = np.zeros((len(suffixes), int(size.max()) + 1), np.uint8)
    for k, x in enumerate(suffixes):
        grid[k, : len(x)] = np.frombuffer(x, np.uint8)
    differ = grid[1:] != grid[:-1]
    differ[:, -1] = True
    return np.minimum(differ.argmax(axis=1), np.minimum(size[1:], size[:-1]))


def _neighbours(batches: Iterator) -> Iterator:
    """The longest match of each suffix with its neighbours in the order of its partition.

    The first and the last of a partition come with their bytes: what they share
    with the partitions beside it is known only when all are done.
    """
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    part, before, held = TaskContext.get().partitionId(), None, None
    names = ["part", "k1", "k2", "reach", "edge", "suffix"]

    def rows(k1, k2, reach, edge=0, suffix=None):
        n = len(k1)
        return pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(reach, pa.int32()), pa.array([edge] * n, pa.int32()), pa.array([suffix] * n, pa.binary())], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        k1, k2, suffixes = batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(0).to_pylist()
        if before is None:
            yield rows(k1[:1], k2[:1], [0], 1, suffixes[0])
        else:
            k1, k2, suffixes = [before[0], *k1], [before[1], *k2], [before[2], *suffixes]
        shared = _common(np, suffixes) if len(suffixes) > 1 else np.zeros(0, np.int64)
        reach = np.maximum(np.append(shared, 0), np.append(held if before is not None else 0, shared))
        # The last one's reach is open until the next batch is there.
        yield rows(k1[:-1], k2[:-1], reach[:-1])
        before, held = (k1[-1], k2[-1], suffixes[-1]), int(reach[-1])
    if before is not None:
        yield rows([before[0]], [before[1]], [held], 2, before[2])


class SuffixIndexFamily:
    """Suffix arrays in levels that grow geometrically."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.levels, self.reaches, self.made = scratch, [], [], 0
        self.parts = max(1, int(scratch.spark.conf.get("spark.sql.shuffle.partitions")))

    def _sorted(self, suffixes: DataFrame) -> DataFrame:
        return suffixes.select("suffix", "k1", "k2").repartitionByRange(self.parts, "suffix", "k1", "k2").sortWithinPartitions("suffix", "k1", "k2")

    def _save(self, df: DataFrame, label: str) -> DataFrame:
        self.made += 1
        return self.scratch.save(df, f"{label}-{self.made}")

    def _scan(self, suffixes: DataFrame) -> None:
        """Records the longest match of every suffix among the given ones."""
        schema = "part int, k1 long, k2 long, reach int, edge int, suffix binary"
        found = self._save(self._sorted(suffixes).mapInArrow(trimmed(_neighbours), schema), "scan")
        self.reaches.append(found.groupBy("k1", "k2").agg(F.max("reach").alias("reach")))
        # Two rows for each partition, so their number doesn't grow with the corpus.
        edges = sorted(found.where("edge > 0").select("part", "edge", "k1", "k2", "suffix").collect(), key=lambda r: (r["part"], r["edge"]))
        met = []
        for x, y in zip(edges, edges[1:]):
            if x["part"] != y["part"]:
                n = next((k for k, (c, d) in enumerate(zip(x["suffix"], y["suffix"])) if c != d), min(len(x["suffix"]), len(y["suffix"])))
                met += [(r["k1"], r["k2"], n) for r in (x, y)]
        if met:
            self.reaches.append(self.scratch.spark.createDataFrame(met, "k1 long, k2 long, reach int"))

    def insert(self, suffixes: DataFrame) -> None:
        """Add a batch (``suffix, k1, k2``); levels hold ``(size, array)``, largest first."""
        array = self._save(self._sorted(suffixes), "batch")
        if not self.levels:
            self._scan(array)
        for _, level in self.levels:
            self._scan(array.unionByName(level))
        self.levels.append((1, array))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, new), (_, old) = self.levels.pop(), self.levels.pop()
            self.levels.append((2 * n, self._save(self._sorted(old.unionByName(new)), "level")))

    def matches(self) -> DataFrame:
        """``k1, k2, reach``: how many bytes any other suffix shares with each."""
        out = self.reaches[0]
        for r in self.reaches[1:]:
            out = out.unionByName(r)
        return out.groupBy("k1", "k2").agg(F.max("reach").alias("reach"))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tk"), text.alias("text"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = 200, batches: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every byte covered by a string of ``min_bytes`` that starts at two places.

    Returns three tables: one row per input row (``doc_id, tk, n_bytes,
    sha``), one per distinct text with repeats inside it or shared with
    another text (``tk, n_bytes, n_removed, n_spans, kept_sha, spans``), and the
    texts that occur in several rows and have ``min_bytes`` at least, which go as
    a whole (``tk, n_bytes``).  ``tk`` is a 64-bit hash of the text; with
    ``n_bytes`` it identifies a text.
    """
    spark = docs.sparkSession
    if min_bytes < GRAM:
        raise ValueError(f"min_bytes must be at least {GRAM}")
    scratch = Scratch(spark, "suffix")
    texts = _texts(docs, id_col, text_col)
    raw = scratch.save(texts.mapInArrow(trimmed(_sampler(min_bytes)), _RAW), "raw")
    whole = scratch.save(raw.where(F.col("n_bytes") >= min_bytes).groupBy("tk", "n_bytes").agg(F.count("*").alias("c")).where("c > 1").select("tk", "n_bytes"), "whole")

    entry = raw.select("tk", "n_bytes", F.explode("suffixes").alias("x")).select("tk", "n_bytes", "x.*")
    # Saved first: a join of two plain shuffles can split a common passage over tasks.
    matches = scratch.save(entry.groupBy("k1").agg(F.count("*").alias("c")).where("c > 1").select("k1"), "matches")
    seen = scratch.save(entry.join(matches, "k1", "left_semi"), "seen")

    # The fingerprints are used up: only what was seen more than once goes on.
    rows = scratch.save(raw.drop("suffixes"), "rows")
    for used in ("raw", "matches"):
        scratch.drop(used)
    text_id = ["tk", "n_bytes"]

    def settle(found: DataFrame, key: str, whole_key: str, place: list[str], label: str) -> tuple[DataFrame, DataFrame]:
        """Rows whose whole bytes occur again, and one row for each kind of bytes where a key has several."""
        kinds = found.groupBy(key, whole_key).agg(F.count("*").alias("c"), F.min(F.struct(*text_id, *place)).alias("r"))
        kinds = scratch.save(kinds, f"{label}-kinds")
        several = scratch.save(kinds.groupBy(key).agg(F.count("*").alias("d")).where("d > 1").select(key), f"{label}-several")
        again = found.join(kinds.where("c > 1").select(key, whole_key), [key, whole_key], "left_semi").select(*text_id, *place).distinct()
        unclear = kinds.join(several, key, "left_semi").select(key, whole_key, "r.*")
        return scratch.save(again, f"{label}-settled"), scratch.save(unclear, f"{label}-open")

    def spans_of(found: DataFrame, first: str, last: str) -> DataFrame:
        return found.select(*text_id, F.col(first).cast("int").alias("a"), (F.col(last) + min_bytes).cast("int").alias("b"))

    # A run that occurs again as a whole is settled; the rest of its suffix's runs are looked into.
    settled, unclear = settle(seen, "k1", "k2", ["p", "s", "e"], "runs")
    scratch.drop("seen")
    needed = settled.select(*text_id).unionByName(unclear.select(*text_id)).distinct()
    sized = texts.select("tk", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    some = scratch.save(sized.join(needed, text_id, "left_semi").groupBy(*text_id).agg(F.first("text").alias("text")), "texts")

    def probe(of: DataFrame, place: list[str], read, schema: str, label: str) -> DataFrame:
        runs = of.groupBy(*text_id).agg(F.collect_list(F.struct(*place)).alias("runs"))
        return scratch.save(some.join(runs, text_id).select(*text_id, "text", "runs").mapInArrow(trimmed(read), schema), label)

    # How far any other suffix agrees with each decides which windows can occur again.
    open_ = probe(unclear, ["k1", "k2", "p", "s", "e"], _suffixes(min_bytes), "suffix binary, tk long, n_bytes long, k1 long, k2 long, p long, s long, e long", "suffixes")
    family = SuffixIndexFamily(scratch)
    for b in range(batches):
        family.insert(open_.where(F.pmod("tk", F.lit(batches)) == b))
    last = F.least(F.col("e"), F.col("p") + F.col("reach") - min_bytes)
    unclear = open_.drop("suffix").join(family.matches(), ["k1", "k2"]).withColumn("e", last).where("e >= s")
    unclear = scratch.save(unclear, "matched")

    # Likewise for bins: one whose shared bytes occur nowhere else holds no repeated
    # window, and one whose covered bytes occur again holds only such.
    bins = probe(unclear, ["p", "s", "e"], _probe(min_bytes, True), "w long, h long, tk long, n_bytes long, p long, lo long, hi long", "bins")
    settled_bins, unclear = settle(bins, "w", "h", ["p", "lo", "hi"], "bins")
    windows = probe(unclear, ["p", "lo", "hi"], _probe(min_bytes, False), "w long, w2 long, tk long, n_bytes long, p long, i long", "windows")
    again = windows.groupBy("w", "w2").agg(F.count("*").alias("c")).where("c > 1").select("w", "w2")
    ends = windows.join(again, ["w", "w2"], "left_semi").groupBy(*text_id, "p").agg(F.min("i").alias("lo"), F.max("i").alias("hi"))
    settled = spans_of(settled, "s", "e").unionByName(spans_of(settled_bins, "lo", "hi"))
    ends = spans_of(ends, "lo", "hi")
    spans = settled.unionByName(ends.select(*text_id, "a", "b")).groupBy(*text_id).agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    cutout = some.join(spans, text_id).select(*text_id, "text", "spans")
    schema = "tk long, n_bytes long, n_removed long, n_spans long, kept_sha string, spans array<struct<a:int,b:int>>"
    return rows, scratch.save(cutout.mapInArrow(trimmed(_digest), schema), "digest"), whole


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = 200, batches: int = 4) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    Null texts count as empty.  Rows with a null or repeated id are judged like
    any other; a text that occurs in two rows and has ``min_bytes`` at least is
    removed from both.  Other columns are ignored.
    """
    raw, digest, whole = repeated_spans(docs, id_col, text_col, min_bytes, batches)
    out = raw.join(digest.drop("spans"), ["tk", "n_bytes"], "left").join(whole.withColumn("whole", F.lit(True)), ["tk", "n_bytes"], "left")
    gone = F.coalesce("whole", F.lit(False))
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(gone, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", F.lit(0).cast("long"))).alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
    )


def _rewrite(batches: Iterator) -> Iterator:
    import pyarrow as pa

    from .texthash import as_bytes

    for batch in batches:
        texts = as_bytes(batch.column("text"))
        kept = [t if s is None else cut(t, [(x["a"], x["b"]) for x in s]) for t, s in zip(texts, batch.column("_spans").to_pylist())]
        kept = [k.decode("utf-8", "ignore") for k in kept]
        rest = [(batch.column(n), n) for n in batch.schema.names if n not in ("text", "_spans")]
        yield pa.RecordBatch.from_arrays([*(c for c, _ in rest), pa.array(kept, pa.string())], names=[*(n for _, n in rest), "text"])


def remove_repeats(docs: DataFrame, text_col: str = "text", min_bytes: int = 200, batches: int = 4) -> DataFrame:
    """``docs`` with the repeated bytes taken out of ``text_col``.

    A character of which only a part is removed goes as a whole.  A null text
    stays null.  All rows and columns stay.
    """
    from pyspark.sql.types import StringType, StructField, StructType

    id_free = docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    _, digest, whole = repeated_spans(id_free, "doc_id", "text", min_bytes, batches)
    spans = digest.select("tk", "n_bytes", "spans").join(whole, ["tk", "n_bytes"], "left_anti")
    full = whole.select("tk", "n_bytes", F.array(F.struct(F.lit(0).alias("a"), F.col("n_bytes").cast("int").alias("b"))).alias("spans"))
    spans = spans.unionByName(full).select(F.col("tk").alias("_tk"), F.col("n_bytes").alias("_n"), F.col("spans").alias("_spans"))
    rest = [c for c in docs.columns if c != text_col]
    text = F.col(text_col).cast("string")
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_rest"), text.alias("text"), text.isNull().alias("_null"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_tk"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("_n"))
    wide = base.join(spans, ["_tk", "_n"], "left").select("_rest", "_null", "text", "_spans")
    schema = StructType([wide.schema["_rest"], wide.schema["_null"], StructField("text", StringType())])
    done = wide.mapInArrow(trimmed(_rewrite), schema)
    columns = [F.when(~F.col("_null"), F.col("text")).alias(text_col) if c == text_col else F.col(f"_rest.`{c}`").alias(c) for c in docs.columns]
    return done.select(*columns)
