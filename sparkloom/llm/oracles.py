"""DuckDB SQL for the corpus queries that SQL can express over whole tables."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"


def url_filters(rules: list[tuple[str, str]], default: str = "allow") -> str:
    values = ", ".join(f"('{a}', '{p}')" for a, p in rules)
    return f"""
with rest as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), parts as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from rest
), rules(action, pattern) as (values {values})
select page_id, host, path, arg_max(pattern, length(pattern)) as rule, coalesce(arg_max(action, length(pattern)), '{default}') as verdict
from parts left join rules
  on (host = split_part(pattern, '/', 1) or ends_with(host, '.' || split_part(pattern, '/', 1))) and starts_with(path, substr(pattern, strpos(pattern, '/')))
group by page_id, host, path"""


def near_duplicates(width: int, percent: int) -> str:
    return f"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') as w from documents
), shingles as (
  select distinct doc_id, unnest(case when len(w) >= {width} then list_transform(range(1, len(w) - {width} + 2), lambda i: array_to_string(w[i:i + {width} - 1], ' '))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from words
), sizes as (select doc_id, count(*) as n from shingles group by doc_id
), shared as (
  select a.doc_id as a, b.doc_id as b, count(*) as k from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2
), links as (
  select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * k >= {percent} * (x.n + y.n - k)
), both_ways as (select a, b from links union all select b, a from links
), reach(doc_id, other) as (
  select doc_id, doc_id from documents union select r.doc_id, l.b from reach r join both_ways l on r.other = l.a
)
select d.doc_id, coalesce(any_value(n), 0)::bigint as n_shingles, min(other) as component_id, d.doc_id = min(other) as kept
from documents d join reach r on r.doc_id = d.doc_id left join sizes s on s.doc_id = d.doc_id group by d.doc_id"""


def suffix_dedup(width: int) -> str:
    return f"""
with docs as (
  select doc_id, encode(coalesce(text, '')) as b from documents
), starts as (
  select doc_id, unnest(range(0, octet_length(b) - {width - 1})) as i, hex(b) as h from docs where octet_length(b) >= {width}
), windows as (
  select doc_id, i, hash(substr(h, 2 * i + 1, {2 * width})) as w from starts
), again as (select w from windows group by w having count(*) > 1
), covered as (
  select doc_id, i, max(i) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) + {width} as reach from windows where w in (select w from again)
), runs as (
  select doc_id, i, sum(case when reach is null or reach < i then 1 else 0 end) over (partition by doc_id order by i) as run from covered
), spans as (
  select doc_id, run, min(i) as a, max(i) + {width} as z from runs group by doc_id, run
), kept as (
  select doc_id, lag(z, 1, 0) over (partition by doc_id order by a) as a, a as z from spans
  union all select doc_id, max(z), octet_length(any_value(b)) from spans join docs using (doc_id) group by doc_id
), joined as (
  select doc_id, string_agg(substr(hex(b), 2 * a + 1, 2 * (z - a)), '' order by a) as h from kept join docs using (doc_id) group by doc_id
), sums as (select doc_id, sum(z - a)::bigint as removed, count(*) as spans from spans group by doc_id)
select doc_id, octet_length(b)::bigint as n_bytes, coalesce(removed, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans,
  sha256(case when h is null then b else unhex(h) end) as kept_sha256
from docs left join joined using (doc_id) left join sums using (doc_id)"""


def source_mixing(cycle: tuple[float, ...], share: float, epochs: float, seed: int, bucket: int) -> str:
    weights = ", ".join(f"{c}::double" for c in cycle)
    return f"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::bigint as size from documents
), per as (
  select source, sum(size)::bigint as source_size, count(*) as docs from sized group by source
), weighed as (
  select *, [{weights}][((row_number() over (order by source nulls last) - 1) % {len(cycle)} + 1)::int] as weight from per
), filled as (
  select *, source_size * {float(epochs)}::double as cap, source_size * {float(epochs)}::double / weight as fill from weighed
), leveled as (
  select *, (sum(source_size) over () * {float(share)}::double - coalesce(sum(cap) over before, 0)) / (sum(weight) over () - coalesce(sum(weight) over before, 0)) as one
  from filled window before as (order by fill, source nulls last rows between unbounded preceding and 1 preceding)
), targets as (
  select source, source_size, docs, least(cap, weight * max(one) over ()) as target from leveled
), placed as (
  select s.doc_id, s.size, t.*, md5('{seed}:' || coalesce(s.doc_id::varchar, '')) as h from sized s join targets t on s.source is not distinct from t.source
), ranked as (
  select *, row_number() over (partition by source order by ('0x' || substr(h, 1, 8))::bigint % ceil(docs / {bucket}.0)::bigint, size desc, h) - 1 as r,
    case when source_size > 0 then target / source_size else 0 end as rate from placed
)
select doc_id, size, source_size, target,
  (size * (floor(rate) + floor((r + 1) * (rate - floor(rate)) + 0.5) - floor(r * (rate - floor(rate)) + 0.5)))::bigint as taken from ranked"""
