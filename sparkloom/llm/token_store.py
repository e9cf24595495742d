"""Token ids in a compressed binary format.

``encode_blocks`` codes 16-bit ids with an adaptive range coder.  Ids are cut
into blocks of ``BLOCK``; each block starts from a fresh model, ends its own code
and carries a CRC-32 of its ids, so blocks can be read alone and a damaged one
is found.  All blocks of a stripe are coded in step, one numpy lane for each.

The model of a block mixes predictions of order 0 to 2.  The ids that last
followed the previous id, and the previous two, are candidates with a small
confidence.  Three adaptive estimates, of order 0 (none), 1 (confidence of the
first) and 2 (of the second), say how likely the next id is the one candidate,
the other, or neither; they are mixed with weights that follow which of them did
best.  What neither predicts goes to the adaptive id frequencies of order 0:
``KNOWN`` ids of the block, each with its count.  An id that isn't among them
costs an adaptive code for its number of bits and those bits.

A stripe is one row of a Parquet table, the container that every store that
Spark writes to can hold: document ids and lengths beside the coded blocks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch
from .workers import trimmed

MAGIC, BLOCK, LANES, SLOTS, KNOWN, SMALL = b"TKB2", 2048, 2048, 1024, 256, 100_000
_U = np.uint64
_LIMIT = _U(1 << 48)


class _Model:
    """Adaptive state of all lanes."""

    def __init__(self, lanes: int):
        self.n = lanes
        self.row = np.arange(lanes)
        self.first = np.full(lanes * SLOTS, -1, np.int32)  # id * 4 + confidence; -1: empty
        self.second = np.full(lanes * SLOTS, -1, np.int32)
        self.one = np.zeros(lanes, np.int64)
        self.two = np.zeros(lanes, np.int64)
        # Estimates of (second's candidate, first's candidate): order, lane, confidence (4: none).
        self.est = np.full((3 * lanes * 5, 2), 0.125, np.float32)
        self.at = np.empty((3, lanes), np.int64)
        self.at[0] = self.row * 5
        self.base = np.array([[0], [lanes * 5], [2 * lanes * 5]]) + self.row * 5
        self.weight = np.full((3, lanes), 1 / 3, np.float32)
        self.rate = np.array([1 / 32, 1 / 16, 1 / 16], np.float32)[:, None, None]
        self.size = np.ones((lanes, 17), np.int32) * 4
        self.cum = None
        # Order 0: the id in each slot, how often it came, and whether ids missed by the others were known.
        self.ids = np.full(lanes * KNOWN, -1, np.int32)
        self.count = np.ones((lanes, KNOWN), np.int32)
        self.known = np.ones((lanes, 2), np.int32) * 8
        self.step = 0

    def look(self):
        """Candidates (-1 if none) and the two bounds of the event's intervals."""
        at = self.row * SLOTS
        self.a1 = at + ((self.one * 40503) >> 3) % SLOTS
        self.a2 = at + ((self.one * 40503 + self.two * 60493 + (self.two >> 5)) >> 2) % SLOTS
        v1, v2 = self.first[self.a1], self.second[self.a2]
        self.c1, self.c2 = v1 >> 2, v2 >> 2
        self.at[1] = self.base[1] + np.where(v1 < 0, 4, v1 & 3)
        self.at[2] = self.base[2] + np.where(v2 < 0, 4, v2 & 3)
        self.p = self.est[self.at]  # order, lane, event
        # Separate products and sums, which every machine rounds alike: the decoder must agree to the last bit.
        w = self.weight[:, :, None] * self.p
        mixed = ((w[0] + w[1] + w[2]) * np.float32(65536)).astype(np.int64)
        self.b2 = np.clip(mixed[:, 0], 32, 40000)
        self.b1 = self.b2 + np.clip(mixed[:, 1], 32, 65000 - self.b2)
        if self.step % 32 == 0:
            total = self.size.sum(axis=1, keepdims=True)
            share = 1 + self.size * (4096 - 17) // total
            share[:, 0] += 4096 - share.sum(axis=1)
            self.cum = np.concatenate([np.zeros((self.n, 1), np.int64), np.cumsum(share, axis=1)], axis=1)
        if self.step % 64 == 0:
            share = 1 + self.count * (4096 - KNOWN) // self.count.sum(axis=1, keepdims=True)
            share[:, 0] += 4096 - share.sum(axis=1)
            self.cum0 = np.zeros((self.n, KNOWN + 1), np.int64)
            np.cumsum(share, axis=1, out=self.cum0[:, 1:])
        self.step += 1

    @staticmethod
    def slot(x):
        return ((x * 40503) >> 4) % KNOWN

    def chance(self, miss):
        """Of 4096: that an id which order 1 and 2 didn't predict is known to order 0."""
        hits = self.known[miss]
        return np.clip(hits[:, 0] * 4096 // hits.sum(axis=1), 64, 4032).astype(np.int64)

    def learn(self, x, event, bits):
        """``event``: 0 second's candidate, 1 first's, 2 neither."""
        p, first, second = self.p, event == 1, event == 0
        got = np.where(second, p[:, :, 0], np.where(first, p[:, :, 1], 1 - p[:, :, 0] - p[:, :, 1]))
        p = p * (1 - self.rate)
        p[:, second, 0] += self.rate[:, :, 0]
        p[:, first, 1] += self.rate[:, :, 0]
        self.est[self.at] = p
        w = self.weight * (np.maximum(got, np.float32(0.001)) + np.float32(0.05))
        w *= 1 / (w[0] + w[1] + w[2])
        w = np.maximum(w, np.float32(0.02))
        self.weight = w * (1 / (w[0] + w[1] + w[2]))
        miss = np.flatnonzero(event == 2)
        ids = x[miss]
        slot = self.slot(ids)
        at = miss * KNOWN + slot
        same = self.ids[at] == ids
        self.known[miss, np.where(same, 0, 1)] += 1
        self.ids[at] = ids
        self.count[miss, slot] = np.where(same, self.count[miss, slot] + 12, 12)
        new = miss[~same]
        self.size[new, bits[new]] += 8
        for table, at in ((self.first, self.a1), (self.second, self.a2)):
            v = table[at]
            same = (v >> 2) == x
            conf = v & 3
            # Right: more confidence. Wrong: less, and at none another candidate.
            table[at] = np.where(same, (x << 2) | np.minimum(conf + 1, 3), np.where((v >= 0) & (conf > 0), v - 1, x << 2))
        self.two, self.one = self.one, x.astype(np.int64)


_BITS = np.array([int(v).bit_length() for v in range(1 << 16)], np.int64)


def _parts(ids: np.ndarray) -> list[np.ndarray]:
    return [ids[a : a + BLOCK] for a in range(0, len(ids), BLOCK)]


def encode_blocks(ids: np.ndarray) -> bytes:
    """All ids (below 65536) as one string of blocks."""
    blocks = _parts(ids.astype(np.int64))
    head = MAGIC + len(blocks).to_bytes(4, "little")
    body = []
    for g in range(0, len(blocks), LANES):
        body += _encode_lanes(blocks[g : g + LANES])
    return head + b"".join(len(b).to_bytes(4, "little") + len(c).to_bytes(4, "little") + zlib.crc32(b.astype("<u4").tobytes()).to_bytes(4, "little") + c for b, c in zip(blocks, body))


def _encode_lanes(blocks: list[np.ndarray]) -> list[bytes]:
    lanes, length = len(blocks), np.array([len(b) for b in blocks])
    data = np.zeros((int(length.max()), lanes), np.int64)
    for k, b in enumerate(blocks):
        data[: len(b), k] = b
    model = _Model(lanes)
    low, span = np.zeros(lanes, _U), np.full(lanes, 0xFFFFFFFFFFFFFFFF, _U)
    out = np.zeros((lanes, 3 * len(data) + 8), np.uint16)
    pos = np.zeros(lanes, np.int64)

    def carry(lane: int):
        k = pos[lane] - 1
        while out[lane, k] == 0xFFFF:
            out[lane, k] = 0
            k -= 1
        out[lane, k] += 1

    live = np.ones(lanes, bool)
    for t in range(len(data)):
        x = data[t]
        if t >= length.min():
            live = length > t
        model.look()
        event = np.where(model.c2 == x, 0, np.where(model.c1 == x, 1, 2))
        bits = _BITS[x]
        start = np.where(event == 0, 0, np.where(event == 1, model.b2, model.b1)).astype(_U)
        end = np.where(event == 0, model.b2, np.where(event == 1, model.b1, 65536)).astype(_U)
        r = span >> _U(16)
        add, new = r * start, r * (end - start)
        miss = np.flatnonzero(event == 2)
        if len(miss):
            ids, k = x[miss], bits[miss]
            slot, split = model.slot(ids), model.chance(miss)
            known = model.ids[miss * KNOWN + slot] == ids
            r = new[miss] >> _U(12)
            a = r * np.where(known, 0, split).astype(_U)
            r = (r * np.where(known, split, 4096 - split).astype(_U)) >> _U(12)
            c0 = np.where(known, model.cum0[miss, slot], model.cum[miss, k]).astype(_U)
            c1 = np.where(known, model.cum0[miss, slot + 1], model.cum[miss, k + 1]).astype(_U)
            a += r * c0
            n = np.where(known, 0, np.maximum(k - 1, 0)).astype(_U)
            r = (r * (c1 - c0)) >> n
            add[miss] += a + r * (ids.astype(_U) & ((_U(1) << n) - _U(1)))
            new[miss] = r
        moved = low + add
        wrapped = (moved < low) & live
        low = np.where(live, moved, low)
        span = np.where(live, new, span)
        if wrapped.any():
            for lane in np.flatnonzero(wrapped).tolist():
                carry(lane)
        small = np.flatnonzero(span < _LIMIT)
        while len(small):
            out[small, pos[small]] = (low[small] >> _U(48)).astype(np.uint16)
            pos[small] += 1
            low[small] <<= _U(16)
            span[small] <<= _U(16)
            small = small[span[small] < _LIMIT]
        model.learn(x, event, bits)
    for _ in range(4):
        out[np.arange(lanes), pos] = (low >> _U(48)).astype(np.uint16)
        pos += 1
        low <<= _U(16)
    return [out[k, : pos[k]].astype("<u2").tobytes() for k in range(lanes)]


def decode_blocks(data: bytes) -> np.ndarray:
    """The ids again.  A block whose checksum doesn't hold raises ``ValueError``."""
    if data[:4] != MAGIC:
        raise ValueError("not a block string")
    blocks, at = [], 8
    for _ in range(int.from_bytes(data[4:8], "little")):
        n, size, crc = (int.from_bytes(data[at + k : at + k + 4], "little") for k in (0, 4, 8))
        blocks.append((n, crc, np.frombuffer(data, "<u2", size // 2, at + 12)))
        at += 12 + size
    out = []
    for g in range(0, len(blocks), LANES):
        out += _decode_lanes(blocks[g : g + LANES])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _decode_lanes(blocks: list) -> list[np.ndarray]:
    lanes, length = len(blocks), np.array([b[0] for b in blocks])
    words = np.zeros((lanes, max(len(b[2]) for b in blocks) + 8), np.uint16)
    for k, b in enumerate(blocks):
        words[k, : len(b[2])] = b[2]
    flat, base = words.ravel(), np.arange(lanes) * words.shape[1]
    pos = np.full(lanes, 4, np.int64)
    code = np.zeros(lanes, _U)  # the code's value less ``low``
    for k in range(4):
        code = (code << _U(16)) | words[:, k].astype(_U)
    span = np.full(lanes, 0xFFFFFFFFFFFFFFFF, _U)
    model = _Model(lanes)
    data = np.zeros((int(length.max()), lanes), np.int64)
    live = np.ones(lanes, bool)
    for t in range(len(data)):
        if t >= length.min():
            live = length > t
        model.look()
        r = span >> _U(16)
        v = np.minimum(code // r, _U(65535)).astype(np.int64)
        event = np.where(v < model.b2, 0, np.where(v < model.b1, 1, 2))
        event = np.where(live, event, 2)
        start = np.where(event == 0, 0, np.where(event == 1, model.b2, model.b1)).astype(_U)
        end = np.where(event == 0, model.b2, np.where(event == 1, model.b1, 65536)).astype(_U)
        sub, new = r * start, r * (end - start)
        x = np.where(event == 0, model.c2, model.c1).astype(np.int64)
        miss = np.flatnonzero(event == 2)
        if len(miss):
            rest = code[miss] - sub[miss]
            split = model.chance(miss)
            r = new[miss] >> _U(12)
            known = rest // np.maximum(r, _U(1)) < split.astype(_U)
            a = r * np.where(known, 0, split).astype(_U)
            r = (r * np.where(known, split, 4096 - split).astype(_U)) >> _U(12)
            v = np.minimum((rest - a) // np.maximum(r, _U(1)), _U(4095)).astype(np.int64)
            k, slot = (model.cum[miss, 1:17] <= v[:, None]).sum(axis=1), np.zeros(len(miss), np.int64)
            half = KNOWN // 2
            while half:  # binary search for the slot
                slot += np.where(model.cum0[miss, slot + half] <= v, half, 0)
                half //= 2
            c0 = np.where(known, model.cum0[miss, slot], model.cum[miss, k]).astype(_U)
            c1 = np.where(known, model.cum0[miss, slot + 1], model.cum[miss, k + 1]).astype(_U)
            a += r * c0
            n = np.where(known, 0, np.maximum(k - 1, 0)).astype(_U)
            r = (r * (c1 - c0)) >> n
            tail = np.minimum((rest - a) // np.maximum(r, _U(1)), (_U(1) << n) - _U(1))
            fresh = np.where(k == 0, 0, tail.astype(np.int64) + (np.int64(1) << np.maximum(k - 1, 0)))
            x[miss] = np.where(known, model.ids[miss * KNOWN + slot], fresh)
            sub[miss] += a + r * tail
            new[miss] = r
        x = np.where(live, x, 0)
        data[t] = x
        code = np.where(live, code - sub, code)
        span = np.where(live, new, span)
        small = np.flatnonzero((span < _LIMIT) & live)
        while len(small):
            code[small] = (code[small] << _U(16)) | flat[base[small] + np.minimum(pos[small], words.shape[1] - 1)].astype(_U)
            pos[small] += 1
            span[small] <<= _U(16)
            small = small[span[small] < _LIMIT]
        # As in the encoder, lanes that have ended go on with id 0.
        event = np.where(live, event, np.where(model.c2 == 0, 0, np.where(model.c1 == 0, 1, 2)))
        model.learn(x, event, _BITS[x])
    out = []
    for k, (n, crc, _) in enumerate(blocks):
        ids = data[:n, k].copy()
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError("checksum")
        out.append(ids)
    return out


class CachedTokenizer:
    """The tokenizers library behind a cache of its own pre-tokens.

    The library splits a text by its pattern and encodes the pieces one by one,
    so pieces seen before need not be encoded again.  A text that holds one of
    the tokenizer's added tokens goes to the library as a whole, and so does
    every text if the tokenizer normalizes.
    """

    def __init__(self, path: str, pattern: str, limit: int = 800_000):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            stated = json.load(f)
        added = [t["content"] for t in stated.get("added_tokens") or []]
        self.whole = regex.compile("" if stated.get("normalizer") else "|".join(map(regex.escape, added)) or r"(?!)").search
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.limit = limit

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 16-bit integers."""
        if self.whole(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        words = self.split(text)
        known = self.known
        new = list({w for w in words if w not in known})
        if new:
            for w, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
                known[w] = struct.pack(f"<{len(e.ids)}H", *e.ids)
        out = b"".join(map(known.__getitem__, words))
        if len(known) > self.limit:
            known.clear()
        return out


def _writer(path: str, pattern: str, end: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        tokens = CachedTokenizer(path, pattern)
        part, stripe = TaskContext.get().partitionId(), 0
        tail = np.array([end], "<u2").tobytes()
        docs, lengths, data, held = [], [], [], 0

        def row():
            ids = np.frombuffer(b"".join(data), "<u2")
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([stripe], pa.int32()),
                    pa.array([docs], pa.list_(pa.int64())),
                    pa.array([lengths], pa.list_(pa.int64())),
                    pa.array([encode_blocks(ids)], pa.binary()),
                ],
                names=["part", "stripe", "docs", "lengths", "data"],
            )

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = tokens.encode(text or "") + tail
                docs.append(doc)
                lengths.append(len(ids) // 2)
                data.append(ids)
                held += len(ids) // 2
                if held >= BLOCK * LANES:
                    yield row()
                    stripe += 1
                    docs, lengths, data, held = [], [], [], 0
        if docs:
            yield row()

    return run


def _reader(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        for docs, lengths, data, first in zip(*(batch.column(k).to_pylist() for k in range(4))):
            ids = decode_blocks(data).astype("<u4")
            at = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(at[:-1] + first), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, pattern: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of every text, with id ``end`` after each, to ``folder`` in ascending id order.

    Null texts are empty; null ids come first; rows that repeat an id follow one
    another in order of a hash of their texts, so that an id with very many rows
    is split over tasks too.  Ids of the tokenizer must be below 65536.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = rows.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    order.mapInArrow(trimmed(_writer(tokenizer, pattern, end)), "part int, stripe int, docs array<long>, lengths array<long>, data binary").write.mode("overwrite").parquet(folder)


def read_tokens(spark, folder: str) -> DataFrame:
    """One row per document of the files: ``doc_id, start, n_tokens, ids_crc32``; checksums are verified."""
    stored = spark.read.parquet(folder)
    sizes = stored.select("part", "stripe", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    ahead = (Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))  # a row for each partition that wrote
    base = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(*ahead)), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("stripe").rowsBetween(*ahead)), F.lit(0))
    first = sizes.withColumn("inside", inside).join(base, "part").select("part", "stripe", (F.col("inside") + F.col("base")).alias("first"))
    if stored.count() <= SMALL:
        first = F.broadcast(first)  # checked: at most SMALL short rows
    read = stored.join(first, ["part", "stripe"]).select("docs", "lengths", "data", "first")
    return read.mapInArrow(trimmed(_reader), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_round_trip(docs: DataFrame, tokenizer: str, pattern: str, end: int = 2) -> DataFrame:
    """Write and read back: what ``read_tokens`` gives for ``docs``."""
    scratch = Scratch(docs.sparkSession, "tokens")
    write_tokens(docs, f"{scratch.root}/files", tokenizer, pattern, end)
    return read_tokens(docs.sparkSession, f"{scratch.root}/files")
