"""Language identification by hierarchical discrimination.

Texts are vectors of hashed byte trigram frequencies.  A first set of one-versus-
one linear support vector machines tells language families apart; inside a
family, one-versus-one machines separate its languages.  Machines vote; summed
margins break ties.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, bound_batches
from .workers import trimmed

#: Families of closely related languages; a language not named is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
}
DIMENSIONS, SAMPLE = 4096, 2000


def _family(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), lang)


def _grams(np, buf):
    """A hash below ``DIMENSIONS`` of the three bytes that start at each place; A-Z as a-z, digits alike."""
    table = np.arange(256, dtype=np.uint32)
    table[65:91] += 32
    table[48:58] = 48
    table[[9, 10, 11, 12, 13]] = 32
    c = table[buf]
    h = (c[:-2] * np.uint32(0x9E3779B1)) ^ (c[1:-1] * np.uint32(0x85EBCA77)) ^ (c[2:] * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(20)).astype(np.int64)


def featurize(texts: list[bytes]):
    """Trigram frequencies, scaled to square roots so that a few frequent ones don't rule."""
    import numpy as np

    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for k, t in enumerate(texts):
        g = _grams(np, np.frombuffer(b" " + t + b"  ", np.uint8))
        out[k] = np.sqrt(np.bincount(g, minlength=DIMENSIONS) / len(g))
    return out


class Model:
    """Families, their languages and the machines between them."""

    def __init__(self, x, langs: list[str]):
        import numpy as np

        from .linear import svm

        y = np.array(langs)
        groups = np.array([_family(v) for v in langs])
        self.families = {f: sorted(set(y[groups == f].tolist())) for f in sorted(set(groups.tolist()))}
        self.machines: list[tuple[str, str, str]] = []  # (level, for, against)
        weights = []
        for level, labels in [("", groups), *((f, y) for f in self.families)]:
            names = sorted(self.families) if not level else self.families[level]
            for a, b in combinations(names, 2):
                mask = (labels == a) | (labels == b)
                w, bias = svm(x[mask], np.where(labels[mask] == a, 1.0, -1.0), l2=1e-5, rounds=200)
                self.machines.append((level, a, b))
                weights.append((w, bias))
        self.w = np.array([w for w, _ in weights]).reshape(len(weights), DIMENSIONS)
        self.b = np.array([b for _, b in weights])

    def predict(self, texts: list[bytes]) -> list[tuple[str, float]]:
        import numpy as np

        out = []
        for t in texts:
            g = _grams(np, np.frombuffer(b" " + t + b"  ", np.uint8))
            margin = self.w @ np.sqrt(np.bincount(g, minlength=DIMENSIONS) / len(g)) + self.b
            family, p = self._winner("", sorted(self.families), margin)
            lang, q = self._winner(family, self.families[family], margin)
            out.append((lang, p * q))
        return out

    def _winner(self, level: str, names: list[str], margin) -> tuple[str, float]:
        if len(names) == 1:
            return names[0], 1.0
        votes = {n: [0, 0.0] for n in names}
        least = {n: float("inf") for n in names}
        for (at, a, b), m in zip(self.machines, margin.tolist()):
            if at == level:
                votes[a if m >= 0 else b][0] += 1
                votes[a][1] += m
                votes[b][1] -= m
                least[a], least[b] = min(least[a], m), min(least[b], -m)
        best = max(names, key=lambda n: tuple(votes[n]))
        return best, 1.0 / (1.0 + float(2.718281828459045 ** (-4.0 * max(-8.0, min(8.0, least[best])))))


def _shares(held: dict[str, int], sample: int) -> dict[str, int]:
    """How many texts of each language are fitted: equal shares, what small languages leave goes to the others."""
    shares = {}
    for k, (lang, n) in enumerate(sorted(held.items(), key=lambda e: (e[1], e[0]))):
        shares[lang] = min(n, (sample - sum(shares.values())) // (len(held) - k))
    return shares


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model | None:
    """A model of at most ``sample`` distinct labelled texts, whole ones; executors count their trigrams.

    Languages share the sample evenly, each with its smallest text hashes; copies
    of a text count once.  The bound is on what is fitted, not on what is judged.
    Null labels and null texts are left out; None if no label is left.
    """
    import zlib

    import numpy as np

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(text_col).cast("string").alias("t"), F.col(lang_col).alias("l"), F.xxhash64(text_col, lang_col).alias("h"))
    pairs = Scratch(docs.sparkSession, "langid").save(rows.select("l", "h").distinct(), "pairs")
    held = {r["l"]: r["count"] for r in pairs.groupBy("l").count().collect()}
    shares = {lang: n for lang, n in _shares(held, sample).items() if n}
    if not shares:
        return None
    # Hashes are even over 64 bits: a bound for each language leaves little more than its share to sort.
    picked: set[int] = set()
    wide, missing = 1.5, dict(shares)
    while missing:
        most = [(lang, int(min(1.0, wide * (n + 10) / held[lang]) * ((1 << 64) - 1)) - (1 << 63)) for lang, n in missing.items()]
        bounds = docs.sparkSession.createDataFrame([(lang, min(h, (1 << 63) - 1)) for lang, h in most], "l string, most long")
        found: dict[str, list[int]] = {}
        for r in pairs.join(F.broadcast(bounds), "l").where("h <= most").select("l", "h").collect():
            found.setdefault(r["l"], []).append(r["h"])
        for lang, n in list(missing.items()):
            if len(found.get(lang, [])) >= n:
                picked.update(sorted(found[lang])[:n])
                del missing[lang]
        wide *= 4

    def vectors(batches: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa

        for batch in batches:
            x = [zlib.compress(featurize([t.encode()]).tobytes(), 1) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.binary())], names=["l", "h", "x"])

    # Copies of a text give equal vectors; of each pair one row comes to the driver.
    chosen = rows.where(F.col("h").isin(list(picked))).dropDuplicates(["l", "h"]).select("l", "h", "t")
    got = sorted(chosen.mapInArrow(trimmed(vectors), "l string, h long, x binary").collect(), key=lambda r: r["h"])
    x = np.zeros((len(got), DIMENSIONS), np.float32)
    for k, r in enumerate(got):
        x[k] = np.frombuffer(zlib.decompress(r["x"]), np.float32)
    return Model(x, [r["l"] for r in got])


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, lang_pred, score``; whole texts are read.

    ``und`` with score 0 if the text is null or has no letter, or nothing was
    learned.  Ids may be null or repeat; other columns are not looked at.
    """

    bound_batches(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import re

        import pyarrow as pa

        letter = re.compile(r"[^\W\d_]")
        for batch in batches:
            texts = batch.column(1).to_pylist()
            good = [k for k, t in enumerate(texts) if t and model is not None and letter.search(t)]
            lang, score = ["und"] * len(texts), [0.0] * len(texts)
            for k, (n, s) in zip(good, model.predict([texts[k].encode() for k in good]) if good else ()):
                lang[k], score[k] = n, s
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(trimmed(run), "doc_id long, lang_pred string, score double")
