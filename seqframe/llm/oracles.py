"""DuckDB texts for the queries whose results SQL can state: plain definitions, without the methods of the operators."""

from __future__ import annotations

from seqframe.llm.licenses import CONTAINED, TEMPLATES, WORDS

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = rf"""
with d as materialized (
  select row_number() over () as r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), b as (
  select item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), want as (
  select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as s
  from (select item_id, w, least(13, len(w)) as n, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from b where len(w) > 0)
), have as (
  select r, i, n, array_to_string(w[i:i + n - 1], ' ') as s
  from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from want) where len(w) >= n)
), hit as (
  select r, i, h.n, item_id from have h join want using (n, s)
), covered as (
  select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from hit) group by r
), named as (
  select r, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct r, cast(item_id as varchar) as item from hit where item_id is not null) group by r
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join covered using (r) left join named using (r)
"""

VECTORS = """
with recursive v as (
  select row_number() over () as r, vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e,
         label is not null and embedding is not null and len(embedding) > 0
         and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
         and len(list_filter(embedding, lambda x: x <> 0)) > 0 as ok
  from embeddings
), link as materialized (
  select a.r as a, b.r as b from v a join v b on a.label = b.label and a.r <> b.r and len(a.e) = len(b.e)
  where a.ok and b.ok and list_cosine_similarity(a.e, b.e) >= 0.93
), reach as (
  select r, r as o from v union select reach.r, link.b from reach join link on reach.o = link.a
), low as (
  select reach.r, min(o.vec_id) as component_id from reach join v o on o.r = reach.o group by 1
), degree as (
  select a as r, count(*) as n from link group by 1
)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept
from v join low using (r) left join degree using (r)
"""

WARC = """
with p as (
  select page_id, encode(coalesce(html, '')) as b from pages
), q as (
  select page_id, cast(octet_length(b) as bigint) as payload_bytes, sha1(b) as payload_digest, max(page_id) over (partition by b) as last from p
)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 1000 and last <> page_id then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 1000 and last <> page_id then last end as refers_to
from q
"""

LICENSES = rf"""
with t(license, text) as (values {", ".join("('" + k + "', '" + v.replace("'", "''") + "')" for k, v in TEMPLATES.items())}),
tw as (
  select license, regexp_extract_all(lower(text), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') as w from t
), want as (
  select distinct license, array_to_string(w[i:i + {WORDS - 1}], ' ') as s
  from (select license, w, unnest(range(1, greatest(1, len(w) - {WORDS - 1}) + 1)) as i from tw)
), size as (
  select license, count(*) as n_shingles from want group by 1
), dw as (
  select distinct doc_id, text, regexp_extract_all(lower(text), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') as w from documents where text is not null
), have as (
  select doc_id, text, array_to_string(w[i:i + {WORDS - 1}], ' ') as s
  from (select doc_id, text, w, unnest(range(1, greatest(1, len(w) - {WORDS - 1}) + 1)) as i from dw where len(w) > 0)
), found as (
  select doc_id, license, count(distinct s) as n_found from have join want using (s) group by doc_id, text, license
)
select doc_id, license, n_shingles, n_found, n_found / n_shingles as containment from found join size using (license)
where n_found / n_shingles >= {CONTAINED}
"""

REPEATS = """
with h as materialized (
  select doc_id, encode(coalesce(text, '')) as b, hex(encode(coalesce(text, ''))) as x, cast(octet_length(encode(coalesce(text, ''))) as bigint) as n from documents
), w as (
  select doc_id, i, row_number() over (partition by s order by doc_id, i) as k
  from (select doc_id, i, substr(x, 2 * i + 1, 200) as s from h, unnest(range(0, n - 99)) as u(i))
), gone as (
  select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 100 then 0 else 1 end as new from w where k > 1
), run as (
  select doc_id, min(i) as s, max(i) + 100 as e from (select *, sum(new) over (partition by doc_id order by i) as g from gone) group by doc_id, g
), piece as (
  select doc_id, s, e, substr(x, 2 * coalesce(lag(e) over (partition by doc_id order by s), 0) + 1,
                              2 * (s - coalesce(lag(e) over (partition by doc_id order by s), 0))) as p
  from run join h using (doc_id)
), cut as (
  select doc_id, cast(sum(e - s) as bigint) as n_removed, count(*) as n_spans, string_agg(p, '' order by s) as front, max(e) as last from piece group by 1
)
select h.doc_id, n as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
       sha256(case when n_spans is null then b else unhex(front || substr(x, 2 * last + 1)) end) as kept_sha256
from h left join cut on h.doc_id = cut.doc_id
"""

EXACT = """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size, doc_id = max(doc_id) over same as kept, sha256(t) as text_sha256
from (select doc_id, coalesce(text, '') as t from documents)
window same as (partition by t)
"""



def _edit(state: str, letter: str, cost: int | str, line: str = "''") -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'r': {state}.r || {line}}}"


def _insert(state: str, role: str) -> str:
    return _edit(state, "I", 3, f"'{role}:' || chr(10)")


def _stay(state: str, to: str | None, role: str, keep: bool = True) -> list[str]:
    """Keeping and reroling a row in ``state``; ``to`` is the initial that Keep needs."""
    kept = f"case when not must and initial = '{to}' then {_edit(state, 'K', 'cut', 'role || chr(58) || text || chr(10)')} end"
    changed = f"case when not must then {_edit(state, 'R', '(3 + cut)', f"'{role}:' || text || chr(10)")} end"
    return [kept] + [changed] * keep


def _least(*options: str) -> str:
    return f"list_min([{', '.join(options)}])"


#: CRC-32 from its polynomial, the damage, the faults, and the edits row by row: of each state the least (cost, audit), with the lines so far.
#: States: nothing, after s, after u, after a; before a row (i2, i3) also by insertions.
CONVERSATIONS = rf"""
with recursive crc as (
  select list(v order by i) as tab from (
    select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end) as v
    from (select unnest(range(256)) as i))
), keyed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), '') as k
  from conversations
), hashed as (
  select conv_id, turn, role, text,
         xor(list_reduce([4294967295] || list_transform(k, lambda x: cast(ascii(x) as bigint)), lambda c, b: xor(tab[cast(xor(c, b) & 255 as bigint) + 1], c >> 8)), 4294967295) % 20 as what
  from keyed, crc
), damaged as (
  select conv_id, turn, case when what = 4 then 'user' else role end as role,
         case what when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case when what = 3 then [1, 2] else [1] end) as copy
  from hashed where what <> 0
), placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as t, substr(role, 1, 1) as initial,
         not regexp_matches(text, '[^\x20\x09-\x0D]') as blank, not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') as open
  from damaged
), judged as (
  select *, not blank and row_number() over (partition by conv_id, role, text order by t) > 1 as again,
         coalesce(lag(initial) over (partition by conv_id order by t) || initial not in ('su', 'ua', 'au'), false) as wrong
  from placed
), line as materialized (
  select conv_id, turn, t, role, text, initial, blank, again, not blank and not again and open as trunc, wrong, blank or again as must,
         case when open then 3 else 0 end as cut
  from judged
), counted as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (again) as duplicate,
         count(*) filter (trunc) as truncated, count(*) filter (wrong) as illegal, max(t) as n
  from line group by conv_id
), state as (
  select conv_id, cast(0 as bigint) as t, {{'c': cast(0 as bigint), 'a': '', 'r': ''}} as s0, {{'c': cast(1000000000 as bigint), 'a': '', 'r': ''}} as s1,
         {{'c': cast(1000000000 as bigint), 'a': '', 'r': ''}} as s2, {{'c': cast(1000000000 as bigint), 'a': '', 'r': ''}} as s3
  from counted
  union all
  select conv_id, t, {_edit("s0", "D", 4)}, {_least(_edit("s1", "D", 4), *_stay("s0", "s", "", False))},
         {_least(_edit("i2", "D", 4), *_stay("s0", "u", "user"), *_stay("s1", "u", "user"), *_stay("i3", "u", "user"))},
         {_least(_edit("i3", "D", 4), *_stay("i2", "a", "assistant"))}
  from (select *, {_least("s3", _insert("i2", "assistant"))} as i3
        from (select l.*, s0, s1, s2, s3, {_least("s2", _insert("s0", "user"), _insert("s1", "user"), _insert("s3", "user"))} as i2
              from state s join line l on l.conv_id is not distinct from s.conv_id and l.t = s.t + 1))
), ended as (
  select conv_id, {_least("s0", "s3", _insert("s4", "assistant"))} as best
  from (select s.*, {_least("s2", _insert("s1", "user"))} as s4 from state s join counted c on s.conv_id is not distinct from c.conv_id where t = n)
)
select i.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
       coalesce(illegal, 0) as illegal, coalesce(best.c, 0) as cost, coalesce(best.a, '') as audit, sha256(coalesce(left(best.r, length(best.r) - 1), '')) as repaired_sha256
from (select distinct conv_id from conversations) i
left join counted c on c.conv_id is not distinct from i.conv_id left join ended e on e.conv_id is not distinct from i.conv_id
"""
