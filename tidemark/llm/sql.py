"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from tidemark.llm.quality_rules import LEAST_WORDS, MOST_REPEATED, RULES, SYMBOLS
from tidemark.llm.signals import STOP_WORDS

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORD = r"[^\x20\x09-\x0D]+"

_RATIOS = {
    "mean_word_length": "word_chars / n_words::double",
    "symbols_per_word": "n_symbols / n_words::double",
    "marks_per_word": "n_marks / n_words::double",
    "stop_words": "n_stop / n_words::double",
    "duplicate_lines": "n_dup_lines / nullif(n_lines, 0)::double",
}


def _rule(rule) -> str:
    value = _RATIOS[rule.ratio]
    tests = ([f"{value} >= {rule.least}::double"] if rule.least is not None else []) + ([f"{value} <= {rule.most}::double"] if rule.most is not None else [])
    return f"(n_words < {rule.from_words} or coalesce({' and '.join(tests)}, true))"


QUALITY_RULES = rf"""
with texts as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
split as (select *, regexp_extract_all(text, '{_WORD}') as w from texts),
windows as (select r, unnest(range(1, len(w) - 3)) as i, w from split where len(w) > 5),
keyed as (select r, i, list_slice(w, i, i + 4) as g from windows),
repeated as (select r, i from (select r, i, count(*) over (partition by r, g) as n from keyed) where n > 1),
covered as (select r, count(distinct i + o) as n from repeated, range(0, 5) t(o) group by r),
line as (select r, unnest(string_split(text, chr(10))) as line from split),
lines as (select r, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from line where trim(line, {_BLANKS}) <> '' group by r),
counts as (
  select doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
    (length(text) - length(translate(text, '{SYMBOLS}', '')))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(covered.n, 0)::bigint as n_repeat_words,
    length(text) - length(translate(text, '!', '')) as n_marks, coalesce(n_lines, 0) as n_lines,
    len(list_filter(w, lambda x: x in ({", ".join(f"'{x}'" for x in STOP_WORDS)}))) as n_stop
  from split left join lines using (r) left join covered using (r)),
judged as (select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words as base_failed from counts)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and {" and ".join(map(_rule, RULES))} as kept
from judged
"""

TOP_K = """
with v as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as p from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.r, q.vec_id as query_id, d.vec_id, coalesce(list_sum(list_transform(list_zip(q.p, d.p), lambda z: coalesce(z[1] * z[2], 0))), 0)::bigint as score
  from v q join v d on q.vec_id % 100 = 0 and q.r <> d.r),
ranked as (select *, row_number() over (partition by r order by score desc, vec_id) as rank from scored)
select query_id, rank::int as rank, vec_id, score from ranked where rank <= 10
"""

NGRAM_COMPONENTS = rf"""
with recursive texts as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') as w from documents),
gram as (select distinct doc_id, list_slice(w, i, i + 4) as g from (select doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) as i from texts where len(w) > 0)),
size as (select doc_id, count(*) as n from gram group by doc_id),
overlap as (select a.doc_id as u, b.doc_id as v, count(*) as o from gram a join gram b on a.g = b.g and a.doc_id <> b.doc_id group by all),
link as (select u, v from overlap join size a on a.doc_id = u join size b on b.doc_id = v where 100 * o >= 75 * (a.n + b.n - o)),
reach(u, v) as (select u, v from link union select r.u, l.v from reach r join link l on r.v = l.u)
select d.doc_id, coalesce(s.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(min(r.v), d.doc_id)) as component_id
from documents d left join size s using (doc_id) left join reach r on r.u = d.doc_id
group by d.doc_id, s.n
"""

WARC = """
with p as (select page_id, coalesce(html, '') as html, strlen(coalesce(html, ''))::bigint as n from pages),
g as (select *, max(page_id) over (partition by html) as best from p)
select page_id, n as payload_bytes, sha1(html) as payload_digest,
  case when n >= 1000 and page_id is distinct from best then 'revisit' else 'response' end as record_type,
  case when n >= 1000 and page_id is distinct from best then best end as refers_to
from g
"""

DIVERGENCE = r"""
with texts as (select coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
groups as (select distinct lang, source from texts),
kept as (select lang, term from (select lang, unnest(list_distinct(w)) as term from texts) group by lang, term having count(*) >= 30),
counts as (select lang, source, term, count(*) as n from (select lang, source, unnest(w) as term from texts) join kept using (lang, term) group by all),
size as (select lang, count(*) as v from kept group by lang),
cell as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n, sum(coalesce(c.n, 0)) over (partition by g.lang, g.source) as whole, v,
    sum(coalesce(c.n, 0)) over (partition by g.lang, k.term) as lang_n, sum(coalesce(c.n, 0)) over (partition by g.lang) as lang_whole
  from groups g join kept k using (lang) join size using (lang) left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
shares as (select lang, source, term, n, 1 + (1000000000 * (n + 5)::hugeint) // (whole + 5 * v) as p, 1 + (1000000000 * (lang_n + 5)::hugeint) // (lang_whole + 5 * v) as q from cell),
sums as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
found as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source
  union all select lang, source, 'term', term, (p - q)::bigint from shares where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from found)
select lang, source, part, item, value, rank::int as rank from ranked where part = 'pair' or rank <= 50
"""

# CRC-32 (polynomial 0xEDB88320, a fixed value) of the decimal digits of a number.
_CRC = """(xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint)), lambda crc, byte:
    list_reduce(list_prepend(xor(crc, byte), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda r, bit: case when r % 2 = 1 then xor(r >> 1, 3988292384) else r >> 1 end)), 4294967295))"""

PREFIX_TRIE = f"""
with clean as (select conv_id as c, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
turns as (select c, row_number() over (partition by c order by turn nulls first, sha256(strlen(role)::varchar || ':' || role || text)) as i, role, text from clean),
convs as (select c, {_CRC} % 9 as h from (select distinct c from turns)),
taken as (
  select v.c, t.i, t.role, t.text from convs v join turns t on t.c = v.c - v.c % 5 and t.i <= v.h
  union all select v.c, t.i, t.role, t.text from convs v join turns t on t.c = v.c and t.i > v.h),
seq as (select c, row_number() over (partition by c order by i) as d, strlen(role)::varchar || ':' || role || text as step, strlen(text) as n_bytes from taken),
path as (select c, d, string_agg(sha256(step), ' ') over (partition by c order by d) as p, coalesce(string_agg(sha256(step), ' ') over (partition by c order by d rows between unbounded preceding and 1 preceding), '') as above, n_bytes from seq),
whole as (select c, 0 as d, '' as p, null as above, 0 as n_bytes from convs union all select * from path),
node as (select p, d, any_value(above) as above, min(c) as conv_id, count(*) as n_convs, any_value(n_bytes) as n_bytes from whole group by p, d),
longest as (select c, max(d) as d from whole group by c),
ends as (select w.p, sha256(string_agg(w.c::varchar, ',' order by w.c)) as ends from whole w join longest using (c, d) group by w.p),
kids as (select above as p, count(*) as n_children from node where above is not null group by above),
below as (
  select u.p, count(*) filter (where k.p is null) as n_leaves, sum((v.n_convs - 1) * v.n_bytes) as saved
  from node v join whole x on x.c = v.conv_id and x.d <= v.d join node u on u.p = x.p left join kids k on k.p = v.p group by u.p)
select n.conv_id, n.d::bigint as depth, a.conv_id as parent_conv_id, n.n_convs, coalesce(k.n_children, 0)::bigint as n_children, b.n_leaves, b.saved::bigint as saved_tokens, coalesce(e.ends, sha256('')) as ends_sha256
from node n left join node a on a.p = n.above left join kids k on k.p = n.p join below b on b.p = n.p left join ends e on e.p = n.p
"""
