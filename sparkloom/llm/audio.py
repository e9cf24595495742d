"""Media columns: chroma fingerprints of recordings, and their alignment.

A recording is a binary column with a WAV file.  Its frames are folded into the
twelve pitch classes; filters over the integral image of that chroma picture
compare neighbouring areas, and each filter's value becomes two bits of a packed
32-bit code, one code for each frame that a whole window fits behind.

Inverted lists of code parts give the frames of two recordings that agree; a
histogram of their offsets proposes alignments, which the share of differing
bits over the whole overlap confirms.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

RATE, FRAME, HOP, WIDTH, BLOCK = 5512, 1024, 344, 16, 4096
#: Filters by rule: (kind, first pitch class, pitch classes, frames) for sixteen of them.
FILTERS = [(k % 3, (5 * k) % 9, 3 + k % 2, 4 * (1 + k % 4)) for k in range(16)]
#: Edges between the four levels of a filter's value.
LEVELS = (-0.15, 0.0, 0.15)
ERRORS, OVERLAP, VOTES, WEAK = 0.2, 16, 1, 3
#: The code of a window without sound: every filter's value is 0, which is in the third of four levels.
SILENT = -1


def decode_wav(data: bytes | None):
    """Samples of 16-bit PCM at ``RATE`` as floats, channels averaged; None if it isn't such a file."""
    import io
    import wave

    import numpy as np

    if not data:
        return None
    try:
        with wave.open(io.BytesIO(data)) as f:
            if f.getsampwidth() != 2:
                return None
            x = np.frombuffer(f.readframes(f.getnframes()), "<i2").reshape(-1, f.getnchannels()).mean(axis=1, dtype=np.float32)
            rate = f.getframerate()
    except (wave.Error, EOFError, ValueError):
        return None
    if rate != RATE and len(x):
        x = np.interp(np.arange(0, len(x) * RATE / rate) * rate / RATE, np.arange(len(x)), x)
    return x / np.float32(32768.0)


def encode_wav(samples) -> bytes:
    import io
    import wave

    import numpy as np

    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(RATE)
        f.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def chroma(x):
    """Energy of the pitch classes for each frame, each frame scaled to length one."""
    import numpy as np

    n = (len(x) - FRAME) // HOP + 1
    if n <= 0:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP][:n]
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    used = (hz >= 200) & (hz <= 2000)
    pitch = np.round(12 * np.log2(hz[used] / 440.0)).astype(int) % 12
    fold = np.zeros((used.sum(), 12))
    fold[np.arange(used.sum()), pitch] = 1
    c = np.zeros((n, 12))
    for a in range(0, n, BLOCK):  # so many frames of a long recording at a time
        power = np.abs(np.fft.rfft(frames[a : a + BLOCK] * np.hanning(FRAME), axis=1)) ** 2
        c[a : a + BLOCK] = np.sqrt(power[:, used] @ fold)
    norm = np.linalg.norm(c, axis=1, keepdims=True)
    return np.where(norm > 1e-6, c / np.maximum(norm, 1e-6), 0.0)


def codes(x):
    """Packed 32-bit codes of a recording, and for each a mask of its ``WEAK`` least certain bits."""
    import numpy as np

    c = chroma(x)
    n = len(c) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    area = np.zeros((len(c) + 1, 13))
    area[1:, 1:] = c.cumsum(axis=0).cumsum(axis=1)
    t = np.arange(n)

    def box(t0, t1, p0, p1):
        return area[t + t1, p1] - area[t + t0, p1] - area[t + t1, p0] + area[t + t0, p0]

    out, bits, margins = np.zeros(n, np.uint32), [], []
    for kind, p, h, w in FILTERS:
        whole = box(0, w, p, p + h)
        if kind == 0:  # earlier against later
            a = box(0, w // 2, p, p + h)
        elif kind == 1:  # lower against higher
            a = box(0, w, p, p + h // 2) * (h / (2.0 * (h // 2)))
        else:  # opposite quarters against the others
            a = box(0, w // 2, p, p + h // 2) + box(w // 2, w, p + h // 2, p + h)
        value = np.log((1.0 + a) / (1.0 + np.maximum(whole - a, 0.0)))
        level = np.searchsorted(LEVELS, value, side="right")
        out = (out << np.uint32(2)) | (level ^ (level >> 1)).astype(np.uint32)  # neighbouring levels differ in one bit
        apart = np.abs(value[:, None] - np.array(LEVELS))
        margins.append(apart.min(axis=1))
        # The bit that changes at the nearest edge: the upper one at the middle edge only.
        bits.append(np.where(apart.argmin(axis=1) == 1, 2, 1).astype(np.uint32) << np.uint32(2 * (len(FILTERS) - 1 - len(bits))))
    least = np.argsort(np.stack(margins), axis=0, kind="stable")[:WEAK]
    weak = np.bitwise_or.reduce(np.take_along_axis(np.stack(bits), least, 0), axis=0)
    return out.view(np.int32), weak.view(np.int32)


def fingerprint(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row per input row: ``id, n_codes, codes, weak``, the last a mask of each code's least certain bits.

    Null, empty and unreadable media, and recordings shorter than a window, have
    no codes.  Ids may be null or repeat; other columns are ignored.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = []
            for data in batch.column(1).to_pylist():
                x = decode_wav(data)
                found.append(([], []) if x is None else codes(x))
            lists = [pa.array([f[c] for f in found], pa.list_(pa.int32())) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(f[0]) for f in found], pa.int64()), *lists], names=["id", "n_codes", "codes", "weak"])

    return media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media")).mapInArrow(run, "id long, n_codes long, codes array<int>, weak array<int>")


def _unsigned(column: str):
    return F.col(column).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))


def _frames(classes: DataFrame, name: str, keys) -> DataFrame:
    """Rows (``key``, ``<name>``, frame, length) for the keys of every frame that isn't silent."""
    frames = classes.select(F.col("class_id").alias(name), F.size("codes").alias(f"{name}_n"), F.posexplode(F.arrays_zip("codes", "weak")).alias(f"{name}_t", "f"))
    frames = frames.where(F.col("f.codes") != SILENT).withColumns({"code": _unsigned("f.codes"), "m": F.coalesce(_unsigned("f.weak"), F.lit(0).cast("long"))})
    return frames.select(F.explode(keys).alias("key"), name, f"{name}_t", f"{name}_n")


def _variants():
    """The code with every choice of its weak bits turned over."""
    out, rest = [F.col("code")], F.col("m")
    for _ in range(WEAK):
        bit = rest.bitwiseAND(-rest)
        out += [o.bitwiseXOR(bit) for o in out]
        rest = rest.bitwiseXOR(bit)
    return F.array_distinct(F.array(*out))


def align_recordings(prints: DataFrame, step: int = 20) -> DataFrame:
    """Aligns the recordings whose id is divisible by ``step`` with all others.

    One row per row of ``prints`` (``id, n_codes, codes, weak``): ``id, n_codes,
    class_id, n_links, best_class, best_offset, best_error``.  Recordings with
    equal codes are one class, named by its smallest id; ``n_links`` is the
    number of other classes that the row's class aligns with, and null where no
    recording of the class is a query.

    Two classes align if at some offset at least ``OVERLAP`` frames overlap, the
    offset has ``VOTES`` votes, and at most a share of ``ERRORS`` of the
    overlap's bits differs.  A frame of a query votes with a frame whose code
    differs in the query's weak bits only; a class asks with those of its
    smallest id, and frames of silence don't vote.  All offsets that reach the
    floor are compared.  The best has the smallest bit error, then the smallest
    id and offset, in frames.  Rows without codes or id have no class.

    Inverted lists of codes produce the votes.  Lists and queries are saved
    tables, so that Spark can split a common code over tasks.
    """
    scratch = Scratch(prints.sparkSession, "audio")
    prints = scratch.save(prints.withColumn("fp", F.when((F.col("n_codes") > 0) & F.col("id").isNotNull(), F.sha2(F.concat_ws(",", F.col("codes").cast("array<string>")), 256))), "prints")
    asked = F.max(F.pmod("id", F.lit(step)) == 0)
    classes = prints.where("fp is not null").groupBy("fp").agg(F.min(F.struct("id", "codes", "weak")).alias("one"), asked.alias("asked"))
    classes = scratch.save(classes.select("fp", "asked", F.col("one.id").alias("class_id"), "one.codes", "one.weak"), "classes")
    queries, records = classes.where("asked"), classes.select("class_id", "codes", "weak")

    wanted = scratch.save(_frames(queries, "q", _variants()), "queries")
    lists = scratch.save(_frames(records, "r", F.array("code")).join(wanted.select("key").distinct(), "key", "left_semi"), "lists")
    offset = F.col("r_t") - F.col("q_t")
    overlap = F.least(F.col("q_n"), F.col("r_n") - offset) - F.greatest(F.lit(0), -offset)
    met = lists.join(wanted, "key").where((F.col("q") != F.col("r")) & (overlap >= OVERLAP))
    peaks = met.groupBy("q", "r", offset.alias("offset")).agg(F.count("*").alias("votes")).where(F.col("votes") >= VOTES)
    pairs = scratch.save(peaks.groupBy("q", "r").agg(F.collect_list("offset").alias("offsets")), "pairs")

    sides = pairs.join(queries.select(F.col("class_id").alias("q"), F.col("codes").alias("x")), "q").join(records.select(F.col("class_id").alias("r"), F.col("codes").alias("y")), "r")
    tried = sides.select("q", "r", "x", "y", F.explode("offsets").alias("offset"))
    tried = tried.withColumn("frames", F.expr("least(size(x), size(y) - offset) - greatest(0, -offset)"))
    wrong = "aggregate(zip_with(slice(x, greatest(0, -offset) + 1, frames), slice(y, greatest(0, offset) + 1, frames), (a, b) -> bit_count((a ^ b) & 4294967295L)), 0, (n, d) -> n + d)"
    tried = tried.withColumn("error", F.expr(wrong) / (F.col("frames") * 32.0)).where(F.col("error") <= ERRORS)
    linked = tried.groupBy("q", "r").agg(F.min(F.struct("error", "r", "offset")).alias("hit"))
    best = linked.groupBy(F.col("q").alias("class_id")).agg(F.count("*").alias("n_links"), F.min("hit").alias("hit"))
    best = scratch.save(best, "best")

    named = classes.select("fp", "class_id", "asked").join(best, "class_id", "left")
    named = named.withColumn("n_links", F.when(F.col("asked"), F.coalesce("n_links", F.lit(0).cast("long"))))
    out = prints.select("id", "n_codes", "fp").join(named, "fp", "left")
    return out.select("id", "n_codes", "class_id", "n_links", F.col("hit.r").alias("best_class"), F.col("hit.offset").alias("best_offset"), F.col("hit.error").alias("best_error"))


def melody(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", segments: int = 32) -> DataFrame:
    """Recordings made from vectors (``id, media``): two notes for each eighth of a second, ``segments`` of them at least.

    All components, in turn, choose notes of two octaves by their size, so equal
    vectors sound equal and close ones alike.  A null or empty vector, or one
    with a component that is null or not finite, has null media.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        length = RATE // 8
        time = np.arange(length) / RATE
        notes = np.array([np.sin(2 * np.pi * 262.0 * 2 ** (k / 12) * time) for k in range(24)]) * np.hanning(length) * 0.4
        for batch in batches:
            media = []
            for v in batch.column(1).to_pylist():
                x = np.array([np.nan if c is None else c for c in v or []], float)
                if not len(x) or not np.isfinite(x).all():
                    media.append(None)
                    continue
                x = np.resize(x / max(1e-12, np.linalg.norm(x)) * np.sqrt(len(x)), max(2 * segments, len(x) + len(x) % 2))
                k = np.clip(((np.tanh(x) + 1) * 12).astype(int), 0, 23)
                media.append(encode_wav((notes[k[0::2]] + notes[k[1::2]]).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], names=["id", "media"])

    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, "id long, media binary")
