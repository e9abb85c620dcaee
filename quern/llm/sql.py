"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from quern.llm.license_templates import NOTICES, PHRASES, TEMPLATES
from quern.llm.licenses import parsed

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = """
with v as (
  select distinct vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as e
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 20 = 0
)
select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 20
"""

OP6 = r"""
with r as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), t as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i, count(*) over (partition by conv_id) as n,
    length('<|im_start|>' || replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<|', '%3C|') || chr(10) || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|im_end|>' || chr(10)) as chars from r
), p as (
  select *, sum(chars) over (partition by conv_id order by i) as prefix from t
)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '')) as loss_sha256,
  sum(prefix) filter (role = 'assistant' or i = n)::bigint as formatted_chars
from p group by conv_id
"""

OP7 = rf"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWERED}'), '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from w
), g as (
  select doc_id, len(s) as n, unnest(s) as g from s
), pairs as (
  select a.doc_id as a, b.doc_id as b, a.n as n, b.n as m, count(*) as k from g a join g b on a.g = b.g and a.doc_id <> b.doc_id group by all
), links as (
  select a, b from pairs where 100 * k >= 80 * (n + m - k)
), reach as (
  select a as doc_id, b as other from links union select r.doc_id, l.b from reach r join links l on r.other = l.a
)
select s.doc_id, len(s)::bigint as n_shingles, least(s.doc_id, coalesce(x.low, s.doc_id)) as component_id
from s left join (select doc_id, min(other) as low from reach group by doc_id) x on x.doc_id = s.doc_id
"""


def pattern(markup: str) -> str:
    """A template as a regular expression over words that each end with a space."""
    parts = []
    for kind, value in parsed(markup):
        if kind == "word":
            parts.append(value + " ")
        elif kind == "words":
            parts.append(f"(?:[^ ]+ ){{{value[0]},{value[1]}}}")
        elif kind == "any":
            parts.append("(?:" + "|".join("".join(w + " " for w in words) for words in value) + ")")
        else:
            parts.append("(?:" if kind == "begin" else ")?")
    return " " + "".join(parts)


def _places(phrase: str) -> str:
    words = phrase.split()
    return f"list_filter(range(0, len(w) - {len(words) - 1}), lambda i: " + " and ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(words)) + ")"


def _case(label: str, markup: str) -> str:
    return f"case when regexp_matches(joined, '{pattern(markup)}') then '{label}' end"


OP10 = rf"""
with w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWERED}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), p as (
  select doc_id, w, ' ' || array_to_string(w, ' ') || ' ' as joined, {", ".join(f"{_places(p)} as p{i}" for i, p in enumerate(PHRASES))} from w
), l as (
  select *, {" || ".join(f"p{i}" for i in range(len(PHRASES)))} as places,
    list_filter([{", ".join(f"case when len(p{i}) > 0 then '{x}' end" for i, x in enumerate(PHRASES.values()))}], lambda x: x is not null) as base,
    {", ".join(f"list_filter([{', '.join(_case(x, m) for x, m in some)}], lambda x: x is not null) as {name}" for name, some in (("whole", TEMPLATES), ("noted", NOTICES)))}
  from p
)
select doc_id, len(w)::bigint as n_words, len(places)::bigint as n_base, list_min(places)::bigint as first_word, list_max(places)::bigint as last_word,
  array_to_string(list_sort(list_distinct(base)), ',') as base_labels, array_to_string(list_sort(list_distinct(base || whole || noted)), ',') as labels,
  case when len(whole) > 0 then 1.0::double when len(noted) > 0 then 0.75::double when len(places) > 0 then 0.5::double else 0.0::double end as score
from l
"""

OP11 = """
with p as (
  select page_id, encode(coalesce(html, '')) as body from pages
), d as (
  select *, octet_length(body)::bigint as payload_bytes, sha1(body) as hex, min(page_id) over (partition by body) as first from p
)
select page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * (i // 4)::int, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31)::int, 1)), '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to
from d
"""

_GRAMS = " union all ".join(f"select lang, [{', '.join(f'w[i + {j}]' for j in range(k))}] as p from places where i + {k - 1} <= len(w)" for k in range(1, 5))
OP12 = rf"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWERED}'), '[.,;:!?\x0A-\x0D]')) as piece from documents
), words as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces
), places as (
  select lang, w, unnest(range(1, len(w) + 1)) as i from words
), totals as (
  select lang, count(*)::bigint as n from places group by lang
), f as (
  select lang, p, count(*)::bigint as f from ({_GRAMS}) group by lang, p having count(*) >= 30
), cuts as (
  select c.lang, c.p, c.f as a, k, l.f as l, r.f as r, (2000000::hugeint * c.f // (l.f::hugeint + r.f::hugeint))::bigint as score
  from (select *, unnest(range(1, len(p))) as k from f where len(p) > 1) c
  join f l on l.lang = c.lang and l.p = c.p[:k] join f r on r.lang = c.lang and r.p = c.p[k + 1:]
), best as (
  select * from cuts qualify row_number() over (partition by lang, p order by score, k) = 1
), held as (
  select lang, p[i:i + s - 1] as p, max(f) as most
  from (select lang, p, f, s, unnest(range(1, len(p) - s + 2)) as i from (select *, unnest(range(2, len(p))) as s from f where len(p) > 2)) group by all
)
select lang, row_number() over (partition by lang order by score desc, a desc, array_to_string(p, ' ')) as rank, array_to_string(p, ' ') as phrase, a, l, r, n, score
from best left join held using (lang, p) join totals using (lang)
where most is null or 100 * most < 80 * a
qualify rank <= 2000
"""
