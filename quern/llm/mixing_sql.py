"""DuckDB SQL for operator 5."""

from __future__ import annotations

from quern.llm.mixing import SCHEDULE, integral

LINES = ", ".join(f"({k}, {i}, " + ", ".join(f"'{float(v)!r}'::double" for v in x) + ")" for k in range(3) for i, x in enumerate(integral(SCHEDULE, k)))

SQL = rf"""
with sizes as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents
), ranked as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source is null, source collate "binary") - 1 as rank from sizes group by source
), capped as (
  select *, (rank % 3 + 1)::double as w, source_size * 3.0::double as cap from ranked
), leveled as (
  select *, (sum(source_size) over () - coalesce(sum(cap) over (order by cap / w, rank rows between unbounded preceding and 1 preceding), 0))
            / sum(w) over (order by cap / w, rank rows between current row and unbounded following) as level from capped
), opened as (
  select *, case when level * w <= cap then row_number() over (order by cap / w, rank) end as place from leveled
), targets as (
  select source, source_size, rank, case when min(place) over () is null then cap else least(cap, arg_min(level, place) over () * w) end as target from opened
), placed as (
  select s.*, t.source_size, t.rank, t.target,
         coalesce(sum(size) over (partition by s.source order by md5(coalesce(doc_id::varchar, '')), doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as start
  from sizes s join targets t on s.source is not distinct from t.source
), lines(kind, i, t, span, share, w, slope) as (values {LINES}), turns as (
  select p.*, e, greatest(0, least(size, floor(target)::bigint - (start + source_size * e)))::bigint as words, (start + source_size * e) / greatest(target, 1.0::double) as due
  from placed p, (values (0), (1), (2)) v(e)
), timed as (
  select u.doc_id, u.source, u.size, u.source_size, u.target, u.words,
         case when words > 0 then l.t + least(l.span, case when due - l.share <= 0 then 0.0::double else (due - l.share) * 2 / (l.w + sqrt(greatest(l.w * l.w + l.slope * (due - l.share) * 2, 0.0::double))) end) end as due_at
  from turns u left join lines l on l.kind = u.rank % 3 and l.share <= u.due and not exists (select 1 from lines m where m.kind = l.kind and m.i > l.i and m.share <= u.due)
)
select doc_id, size, source_size, target, sum(words)::bigint as taken, source, min(due_at) as first_at from timed group by doc_id, source, size, source_size, target
"""
