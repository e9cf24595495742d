"""Toxicity by classifier chains.

Categories are predicted one after another by logistic regressions; each model
also sees the probabilities of the categories before it.  While training, those
are out-of-fold predictions, so a later model learns how far to trust earlier
ones on texts they were not fitted to.

Features say which words and word beginnings a text holds.  Only those that are
surely more frequent in a category than elsewhere are kept, so the length of a
text doesn't drown the few words that matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, bound_batches
from .workers import trimmed

SAMPLE, FEATURES, FOLDS, BUCKETS = 6000, 300, 5, 1 << 22
#: Strength of the penalty and steps of every fit.
L2, ROUNDS = 1e-3, 400
#: Log odds that a feature must reach with confidence.
MARGIN = 1.5
#: Lengths of word beginnings used as features, besides whole words.
STEMS = (4, 5, 6, 7)
_WORD = r"[^\W\d_]+|[^\w\s]{2,}|[|]"


def word_features(word: str) -> list[int]:
    """Buckets of a word and its beginnings."""
    raw = [b"=" + word.encode()] + [word[:n].encode() for n in STEMS if len(word) >= n]
    return [zlib.crc32(r) % BUCKETS for r in raw]


def text_features(found) -> "np.ndarray":
    """Buckets of a text from those of its distinct words: held at all, by two words, by three."""
    import numpy as np

    base, count = np.unique(np.asarray(found, np.int64), return_counts=True)
    return np.concatenate([base, _nth(base[count > 1], 2), _nth(base[count > 2], 3)])


def _nth(base, n: int):
    return (base * 2654435761 + n * 40503) % BUCKETS


def text_buckets(text: str, of: dict[str, list[int]]) -> "np.ndarray":
    """Buckets of a whole text; ``of`` remembers those of words."""
    import re

    import numpy as np

    words = set(re.findall(_WORD, text.lower()))
    of.update([(w, word_features(w)) for w in words if w not in of])
    held = np.unique(text_features([f for w in words for f in of[w]])).astype(np.int32)
    if len(of) > 200_000:
        of.clear()
    return held


class Chain:
    """One linear model for each category, in order.

    ``index`` numbers the buckets that are features, ``held`` has the numbers that
    each text holds, and ``fold`` the texts' folds.
    """

    def __init__(self, held: list[list[int]], labels: dict[str, list[int]], index: dict[int, int], fold):
        import numpy as np

        from .linear import logistic, sigmoid

        self.categories, self.index = list(labels), index
        x = np.zeros((len(held), len(index)), np.float32)
        for k, h in enumerate(held):
            x[k, h] = 1
        fold, folds = np.asarray(fold), FOLDS
        self.models = []
        chain = x
        for name in self.categories:
            y = np.array(labels[name], float)
            out = np.zeros(len(y))
            for f in range(folds):
                if (fold == f).any() and (fold != f).any():
                    w, b = logistic(chain[fold != f], y[fold != f], l2=L2, rounds=ROUNDS, balanced=False)
                    out[fold == f] = sigmoid(chain[fold == f] @ w + b)
            self.models.append(logistic(chain, y, l2=L2, rounds=ROUNDS, balanced=False))
            chain = np.hstack([chain, out[:, None].astype(np.float32)])
        self.out_of_fold = chain[:, x.shape[1] :]
        self._known: dict[str, tuple[int, ...]] = {}
        self._useful = None

    def predict(self, texts: list[str]):
        """Probabilities, a row for each text and a column for each category."""
        import re

        import numpy as np

        from .linear import sigmoid

        find, known, index = re.compile(_WORD).findall, self._known, self.index
        if self._useful is None:  # buckets that say something, alone or together
            useful, every = np.zeros(BUCKETS, bool), np.arange(BUCKETS, dtype=np.int64)
            useful[list(index)] = True
            self._useful = useful | useful[_nth(every, 2)] | useful[_nth(every, 3)]
        useful = self._useful
        score = np.zeros((len(texts), len(self.models)))
        base = np.array([w[: len(index)] for w, _ in self.models])
        for k, t in enumerate(texts):
            held: list[int] = []
            for w in set(find(t.lower())):
                if w not in known:
                    known[w] = tuple(f for f in word_features(w) if useful[f])
                held += known[w]
            score[k] = base[:, [index[f] for f in np.unique(text_features(held)).tolist() if f in index]].sum(axis=1)
            if len(known) > 200_000:
                known.clear()
        for c, (w, b) in enumerate(self.models):
            score[:, c] = sigmoid(score[:, c] + score[:, :c] @ w[len(index) :] + b)
        return score

    def __getstate__(self):
        return self.__dict__ | {"_known": {}, "_useful": None, "out_of_fold": None}


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str], sample: int = SAMPLE) -> Chain | None:
    """A chain fitted to at most ``sample`` labelled documents, by smallest hash of the id.

    ``categories`` maps names to SQL conditions on ``labels`` (``doc_id`` and
    others), in the chain's order.  Labels that are null count as 0; an id that
    is labelled twice has a category if one of its rows has; ids without a text
    are left out, and of an id with several texts the one of smallest hash is
    taken.  None if nothing is left.

    Executors read the texts and count their features; the driver gets the
    chosen features, and for each text which of them it holds.
    """
    import numpy as np

    names = [f"c{k}" for k in range(len(categories))]
    flags = [F.max(F.coalesce(F.expr(c).cast("int"), F.lit(0))).alias(n) for n, c in zip(names, categories.values())]
    chosen = labels.where("doc_id is not null").groupBy("doc_id").agg(*flags).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null")
    rows = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", *names).agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("t"))  # at most ``sample`` rows

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        of: dict[str, list[int]] = {}
        for batch in batches:
            texts = batch.column(len(names) + 1).to_pylist()
            fold = pa.array([zlib.crc32(t.encode()) % FOLDS for t in texts], pa.int32())  # copies of a text share a fold
            held = pa.array([text_buckets(t, of) for t in texts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], fold, held], names=[*batch.schema.names[:-1], "fold", "held"])

    schema = "doc_id long, " + ", ".join(f"{n} int" for n in names) + ", fold int, held array<int>"
    read_rows = rows.select(F.col("doc_id").cast("long"), *names, "t.text").mapInArrow(trimmed(read), schema)
    texts = Scratch(docs.sparkSession, "toxicity").save(read_rows, "texts")
    total, *positive = texts.agg(F.count("*"), *[F.sum(n) for n in names]).first()
    if not total:
        return None
    counts = texts.select(*names, F.explode("held").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("every"), *[F.sum(n).alias(n) for n in names]).where("every >= 5")
    index: dict[int, int] = {}
    for n, p in zip(names, positive):
        p, q = max(1, p), max(1, total - p)
        a, b = F.col(n), F.col("every") - F.col(n)
        odds = F.log((a + 0.5) / (p - a + 0.5)) - F.log((b + 0.5) / (q - b + 0.5))
        sure = odds - 2 * F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))  # what the odds are at least
        for r in counts.select("bucket", sure.alias("sure")).where(F.col("sure") > MARGIN).orderBy(F.desc("sure"), "bucket").limit(FEATURES).collect():
            index.setdefault(r["bucket"], len(index))
    useful = F.array(*[F.lit(b) for b in index]).cast("array<int>")
    got = texts.select("doc_id", *names, "fold", F.array_intersect("held", useful).alias("held")).orderBy("doc_id").collect()
    held = [[index[b] for b in r["held"]] for r in got]
    return Chain(held, {c: [r[n] for r in got] for n, c in zip(names, categories)}, index, np.array([r["fold"] for r in got]))


def score_toxicity(docs: DataFrame, chain: Chain | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id`` and the probability of each category.

    Whole texts are judged.  Null and empty texts have the probabilities of a
    text without any known word; without a chain all are 0.  Ids may be null or
    repeat, and other columns are not looked at.
    """
    bound_batches(docs.sparkSession)
    names = chain.categories if chain else ["toxic"]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            p = chain.predict(texts) if chain else np.zeros((len(texts), 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, c]) for c in range(len(names)))], names=["doc_id", *names])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(trimmed(run), "doc_id long, " + ", ".join(f"`{n}` double" for n in names))


def drop_toxic(docs: DataFrame, chain: Chain | None, category: str = "toxic", threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose probability is below ``threshold``, unchanged."""
    if chain is None:
        return docs
    bound_batches(docs.sparkSession)
    at, place = chain.categories.index(category), docs.columns.index(text_col)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            clean = chain.predict([t or "" for t in batch.column(place).to_pylist()])[:, at] < threshold
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(trimmed(run), docs.schema)
