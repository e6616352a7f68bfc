"""SQL that gives the same rows as the operators that SQL can express (run on small tables)."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_REACH = """, reach(v, r) as (select a, b from link union select r.v, l.b from reach r join link l on l.a = r.r), label as (select v, min(least(v, r)) as c from reach group by v)"""

OP1 = rf"""with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select doc_id, unnest(case when len(ws) >= 4 then list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' '))) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as sh from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.sh = y.sh and x.doc_id <> y.doc_id group by 1, 2),
link as (select a, b from p join n i on i.doc_id = a join n j on j.doc_id = b where 100 * c >= 80 * (i.n + j.n - c)){_REACH}
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(c, d.doc_id) as component_id, coalesce(c, d.doc_id) = d.doc_id as kept from documents d left join n on n.doc_id = d.doc_id left join label on v = d.doc_id"""

OP3 = f"""with recursive fine as (select vec_id, embedding::double[] as e, label from embeddings where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
link as (select x.vec_id as a, y.vec_id as b from fine x join fine y on x.label = y.label and x.vec_id <> y.vec_id and len(x.e) = len(y.e) where list_cosine_similarity(x.e, y.e) >= 0.98){_REACH},
n as (select a, count(*) as n from link group by a)
select vec_id, coalesce(n, 0) as n_links, coalesce(c, vec_id) as component_id, coalesce(c, vec_id) = vec_id as kept from embeddings left join n on a = vec_id left join label on v = vec_id"""

OP7 = """with b as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents), s as (select doc_id, h, length(h) // 2 as n from b),
q as (select doc_id, n, block, substr(h, 2 * block + 1, 2098) as part from (select doc_id, h, n, unnest(range(0, n - 49, 1000)) as block from s) x),
p as (select doc_id, block + k as pos, substr(part, 2 * k + 1, 100) as g from (select doc_id, block, part, unnest(range(0, least(1000, n - 49 - block))) as k from q) x),
f as (select g, min(doc_id) as first from p group by g),
c as (select p.doc_id, pos from p join f using (g) where p.doc_id > first),
m as (select doc_id, pos, case when pos - lag(pos) over (partition by doc_id order by pos) <= 50 then 0 else 1 end as new from c),
i as (select doc_id, pos, sum(new) over (partition by doc_id order by pos) as k from m),
r as (select doc_id, k, min(pos) as x, max(pos) + 50 as y from i group by 1, 2),
o as (select doc_id, k, x, y, coalesce(lag(y) over (partition by doc_id order by k), 0) as prev from r),
kept as (select doc_id, string_agg(substr(h, 2 * prev + 1, 2 * (x - prev)), '' order by k) || substr(any_value(h), 2 * max(y) + 1) as h, sum(y - x) as n_removed, count(*) as n_spans from o join s using (doc_id) group by doc_id)
select s.doc_id, s.n as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept.h, s.h))) as kept_sha256 from s left join kept on kept.doc_id = s.doc_id"""

_H = lambda k: f"('0x' || substr(h, {8 * k + 1}, 8))::bigint"

OP12 = rf"""with t as (select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(doc_id::varchar, '')) as h, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as tok from documents),
c as (select *, len(tok) as n, {_H(0)} % (len(tok) + 1) as c1, {_H(1)} % (len(tok) + 1) as c2, case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or {_H(2)} % 100 >= 50 then 'plain' when {_H(3)} % 100 < 80 then 'spm' else 'psm' end as form from t),
p as (select *, array_to_string(tok[1:least(c1, c2)], '') as prefix, array_to_string(tok[least(c1, c2) + 1:greatest(c1, c2)], '') as middle, array_to_string(tok[greatest(c1, c2) + 1:], '') as suffix from c)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256, sha256(text) as restored_sha256 from p"""

OP13 = r"""with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -7, k, case k when 0 then 'user' else 'assistant' end, '\### Assistant: </turn> ok' from range(2) r(k)),
e as (select *, length(role) + length(text) + sum_of + 16 as size from (select *, len(regexp_extract_all(role || text, '[\\<>]')) as sum_of from c))
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256, sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, text) filter (where role = 'assistant'), '')) as loss_sha256, sum(size)::bigint as formatted_chars from e group by conv_id"""


def _plus(state: str, cost: int, letter: str) -> str:
    """A state is its cost in nine digits and its audit."""
    return f"lpad((left({state}, 9)::int + {cost})::varchar, 9, '0') || substr({state}, 10) || '{letter}'"


def _inserted(s: list[str]) -> list[str]:
    """States with any inserts behind them: nothing, system, user, assistant."""
    two = lambda x: _plus(x, 10, "II")
    return [s[0], s[1], f"least({s[2]}, {', '.join(_plus(s[k], 5, 'I') for k in (0, 1, 3))})", f"least({s[3]}, {_plus(s[2], 5, 'I')}, {two(s[0])}, {two(s[1])})"]


def _edit(state: str, initial: str) -> str:
    """Keep where the initial fits, else change the role; not for rows that have to go."""
    k, r = _plus(state, 0, "K"), _plus(state, 1, "R")
    kt, rt = _plus(state, 5, "K"), _plus(state, 6, "R")
    return f"case when r.must then null when r.cut then case when r.i = '{initial}' then {kt} else {rt} end when r.i = '{initial}' then {k} else {r} end"


_C = ["c0", "c1", "c2", "c3"]
_S = ["s0", "s1", "s2", "s3"]
_WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP11 = rf"""with recursive base as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text from conversations),
keyed as (select *, encode(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')) as key from base),
crcs(key, k, crc) as (select distinct key, 0, 4294967295::bigint from keyed union all
  select key, k + 1, list_reduce([xor(crc, ('0x' || substr(hex(key), 2 * k + 1, 2))::bigint), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end) from crcs where k < octet_length(key)),
kinds as (select key, xor(crc, 4294967295) % 20 as kind from crcs where k = octet_length(key)),
dam as (select conv_id, turn, case when kind = 4 then 'user' else role end as role, case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case kind when 0 then 0 when 3 then 2 else 1 end)) as copy from keyed join kinds using (key)),
num as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as rn, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as nth, rtrim(text, {_WS}) as trimmed, left(role, 1) as i from dam),
faults as (select *, case when trimmed = '' then 'blank' when nth > 1 then 'duplicate' when right(trimmed, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault, lag(i) over (partition by conv_id order by rn) as before from num),
counts as (select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count_if(fault = 'blank') as blank, count_if(fault = 'duplicate') as duplicate, count_if(fault = 'truncated') as truncated, count_if(before || i not in ('su', 'ua', 'au')) as illegal from faults group by conv_id),
steps(conv_id, rn, s0, s1, s2, s3) as (select conv_id, 0::bigint, '000000000', null::varchar, null::varchar, null::varchar from counts union all
  select conv_id, rn, {_plus('c0', 2, 'D')}, least({_plus('c1', 2, 'D')}, case when i = 's' and not must then case when cut then {_plus('c0', 5, 'K')} else {_plus('c0', 0, 'K')} end end),
    least({_plus('c2', 2, 'D')}, {', '.join(_edit(c, 'u') for c in ('c0', 'c1', 'c3'))}), least({_plus('c3', 2, 'D')}, {_edit('c2', 'a')}) from
  (select r.conv_id, r.rn, r.i, r.fault in ('blank', 'duplicate') as must, r.fault = 'truncated' as cut, {', '.join(f'{x} as {n}' for x, n in zip(_inserted(_S), _C, strict=True))} from steps join faults r on r.conv_id is not distinct from steps.conv_id and r.rn = steps.rn + 1) r),
done as (select conv_id, substr(least(f[1], f[4]), 10) as audit, left(least(f[1], f[4]), 9)::bigint as cost, c.* exclude (conv_id) from (select steps.conv_id, [{', '.join(_inserted(_S))}] as f, rn from steps) s join counts c using (conv_id) where rn = n),
letters as (select conv_id, unnest(range(1, length(audit) + 1)) as p, audit from done), edits as (select conv_id, p, substr(audit, p, 1) as e, p - length(replace(left(audit, p), 'I', '')) as ins, length(replace(left(audit, p), 'D', '')) as nth_out from letters),
placed as (select e.conv_id, p, e, nth_out, role, text, i from edits e left join faults f on f.conv_id = e.conv_id and f.rn = p - ins and e.e <> 'I' where e <> 'D'),
heads as (select conv_id, bool_or(nth_out = 1 and e = 'K' and i = 's') as sys from placed group by conv_id),
said as (select conv_id, string_agg(case when e = 'K' then role when (nth_out - sys::int) % 2 = 1 then 'user' else 'assistant' end || ':' || coalesce(text, ''), chr(10) order by p) as t from placed join heads using (conv_id) group by conv_id)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(cost, 0) as cost, coalesce(audit, '') as audit, sha256(coalesce(t, '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join done using (conv_id) left join said using (conv_id)"""
