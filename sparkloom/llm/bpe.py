"""Byte-level BPE encoding and decoding with recursive DuckDB queries.

Each partition splits its texts with the tokenizer's pattern, keeps every
distinct piece once, and lets DuckDB contract them: rows of (piece, position,
token) join the merge table, every piece contracts its leftmost pair of lowest
rank, and the recursion ends when no piece has a pair left.  Decoding is the
ordered aggregation of the bytes of every piece's ids.  Documents are then put
together from their pieces' ids and bytes, so a word costs one contraction for
each partition and not one for each time it is written.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import bound_batches
from .workers import trimmed

#: Distinct pieces contracted together, occurrences held before that, and pieces remembered.
CHUNK, HELD, KNOWN = 120_000, 4_000_000, 500_000
#: Pieces of more bytes contract all pairs of the lowest rank in a step, shorter ones the leftmost.
LONG = 64

#: What a recursion yields, as ids and bytes of each piece; pieces that are tokens need no contraction.
_GATHER = """
select w, string_agg(t.id::varchar, ',' order by p) as ids, count(*) as n, string_agg(hex, '' order by p) as hex
from ({}) t join bytes on bytes.id = t.id group by w
"""

#: A row: a piece's number, a token's place and id, and whether the piece has no pair left.
#: ``best`` packs the lowest rank of a piece and, below 12 bits, its leftmost place.
_STEP = """
with recursive step(w, p, id, done) as (
  select w, p, id, false from piece
  union all
  select * from (
    with pair as materialized (
      select w, p, id, lead(id) over run as nid, lag(p) over run as prev
      from step where not done window run as (partition by w order by p)
    ), ranked as materialized (
      select w, min((m.merged::bigint << 12) | pair.p) as best
      from pair join merge m on m.pair = (pair.id::bigint << 20) | pair.nid group by w
    )
    select pair.w, pair.p, case when pair.p = (best & 4095) then (best >> 12)::int else id end, best is null
    from pair left join ranked on pair.w = ranked.w
    where best is null or prev is distinct from (best & 4095)
  )
)
select w, p, id from step where done
"""

#: The same result in fewer steps, for long pieces: of the lowest rank's pairs, every other one of
#: adjoining ones, from the left, is contracted at once.  A contraction that makes a pair of lower rank
#: ends the step after it, since that pair comes before the rest.
_STEP_ALL = """
with recursive step(w, p, id, done) as (
  select w, p, id, false from piece
  union all
  select * from (
    with pair as materialized (
      select w, p, k, id, id2, id3, m.merged as r, min(m.merged) over (partition by w) as best from (
        select w, p, id, row_number() over run as k, lead(id) over run as id2, lead(id, 2) over run as id3
        from step where not done window run as (partition by w order by p)
      ) t left join merge m on m.pair = (t.id::bigint << 20) | t.id2
    ), hit as materialized (
      select w, k, id3, best, (row_number() over (partition by w, island order by k) - 1) as turn from (
        select *, k - row_number() over (partition by w order by k) as island from pair where r = best
      )
    ), taken as materialized (
      select w, k, best, id3, lag(k) over (partition by w order by k) as before from hit where turn % 2 = 0
    ), ends as (
      select t.w, min(t.k) as last
      from taken t left join pair l on l.w = t.w and l.k = t.k - 1
      left join merge a on a.pair = ((case when t.before = t.k - 2 then t.best else l.id end)::bigint << 20) | t.best
      left join merge b on b.pair = (t.best::bigint << 20) | t.id3
      where least(a.merged, b.merged) < t.best group by t.w
    ), done_now as (
      select t.w, t.k, t.best from taken t left join ends e on e.w = t.w where e.last is null or t.k <= e.last
    )
    select p.w, p.p, coalesce(d.best, p.id), p.best is null
    from pair p left join done_now d on d.w = p.w and d.k = p.k
    where not exists (select 1 from done_now x where x.w = p.w and x.k = p.k - 1)
  )
)
select w, p, id from step where done
"""


def load_ranks(path: str) -> dict[bytes, int]:
    """A ``.tiktoken`` file as a map from token bytes to rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Contractor:
    """Ids and decoded bytes of pieces, from a DuckDB database in memory."""

    def __init__(self, path: str):
        import duckdb
        import numpy as np
        import pyarrow as pa

        self.ranks = load_ranks(path)
        left, right, merged = [], [], []
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        self.start = np.zeros(256, np.int32)
        for token, rank in self.ranks.items():
            if len(token) == 1:
                self.start[token[0]] = rank
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        pairs = pa.table({"pair": (np.array(left, np.int64) << 20) | np.array(right, np.int64), "merged": np.array(merged, np.int32)})
        byte = pa.table({"id": list(self.ranks.values()), "hex": [t.hex() for t in self.ranks]})
        for name, table in (("merge", pairs), ("bytes", byte)):
            self.db.register("given", table)
            self.db.execute(f"create table {name} as select * from given")
            self.db.unregister("given")

    def contract(self, pieces: list[str]) -> tuple[list[str], list[int], list[bytes]]:
        """For each piece its ids joined by commas, their number, and the bytes that they decode to."""
        import numpy as np
        import pyarrow as pa

        raw = [p.encode() for p in pieces]
        ids, counts, back = [""] * len(raw), [0] * len(raw), [b""] * len(raw)
        tokens = [k for k, r in enumerate(raw) if r in self.ranks]  # a piece that is a token is that token
        short = [k for k, r in enumerate(raw) if r not in self.ranks and len(r) <= LONG]
        long = [k for k, r in enumerate(raw) if r not in self.ranks and len(r) > LONG]
        for group, recursion in ((tokens, "select w, p, id from piece"), (short, _STEP), (long, _STEP_ALL)):
            if not group:
                continue
            length = np.array([1 if group is tokens else len(raw[k]) for k in group], np.int64)
            if group is tokens:
                flat = np.array([self.ranks[raw[k]] for k in group], np.int32)
            else:
                flat = self.start[np.frombuffer(b"".join(raw[k] for k in group), np.uint8)]
            place = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
            self.db.register("piece", pa.table({"w": np.repeat(np.array(group, np.int32), length), "p": place.astype(np.int32), "id": flat}))
            done = self.db.sql(_GATHER.format(recursion)).to_arrow_table()
            self.db.unregister("piece")
            for k, i, n, h in zip(*(done.column(c).to_pylist() for c in ("w", "ids", "n", "hex"))):
                ids[k], counts[k], back[k] = i, n, bytes.fromhex(h)
        return ids, counts, back


def _encoder(path: str, pattern: str, keep_ids: bool):
    def run(batches: Iterator) -> Iterator:
        import hashlib

        import numpy as np
        import pyarrow as pa
        import regex

        split = regex.compile(pattern).findall
        duck = Contractor(path)
        number: dict[str, int] = {}
        ids: list[str] = []
        counts: list[int] = []
        back: list[bytes] = []
        held: list = []

        def flush():
            new = list(number)[len(ids) :]
            for got, into in zip(duck.contract(new), (ids, counts, back)):
                into.extend(got)
            size = np.array(counts, np.int64)
            docs, total, sha, whole, lists = [], [], [], [], []
            for doc, index in held:
                order = index.tolist()
                text = ",".join(map(ids.__getitem__, order))
                docs.append(doc)
                total.append(int(size[index].sum()))
                sha.append(hashlib.sha256(text.encode()).hexdigest())
                whole.append(hashlib.sha256(b"".join(map(back.__getitem__, order))).hexdigest())
                if keep_ids:
                    lists.append([int(x) for x in text.split(",")] if text else [])
            held.clear()
            if len(number) > KNOWN:
                number.clear()
                ids.clear()
                counts.clear()
                back.clear()
            out = [pa.array(docs, pa.int64()), pa.array(total, pa.int64()), pa.array(sha, pa.string()), pa.array(whole, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                out.append(pa.array(lists, pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(out, names=names)

        pending = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = split(text) if text else []
                index = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words))
                held.append((doc, index))
                pending += len(words)
                if pending > HELD or len(number) - len(ids) > CHUNK:
                    yield flush()
                    pending = 0
        if held:
            yield flush()
        duck.db.close()

    return run


def bpe_encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, ids_sha256, decoded_sha256``, and ``ids`` if asked for.

    ``path`` names a ``.tiktoken`` rank file that every executor has, ``pattern``
    the regular expression that splits a text.  Null and empty texts have no
    tokens.  Ids may be null or repeat; each row is encoded by itself.  Other
    columns are ignored.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "")
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(trimmed(_encoder(path, pattern, keep_ids)), schema)


def bpe_decode(ids: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts (``doc_id, text``) of token id arrays, by ordered aggregation in DuckDB.

    Bytes that are not UTF-8 become U+FFFD.  A null array gives a null text;
    an id without a token raises ``ValueError``.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        db = Contractor(path).db
        for batch in batches:
            rows = pa.table({"k": pa.array(range(batch.num_rows), pa.int32()), "ids": batch.column(1)})
            db.register("given", rows)
            sql = """with t as (select k, unnest(ids) as id, generate_subscripts(ids, 1) as p from given)
                     select k, string_agg(hex, '' order by p) as hex, count(*) - count(hex) as bad from t left join bytes using (id) group by k"""
            got = {k: (h, bad) for k, h, bad in db.execute(sql).fetchall()}
            db.unregister("given")
            if any(bad for _, bad in got.values()):
                raise ValueError("an id has no token")
            whole = [None if v is None else bytes.fromhex(got.get(k, ("", 0))[0]).decode("utf-8", "replace") for k, v in enumerate(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(whole, pa.string())], names=["doc_id", "text"])

    return ids.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
