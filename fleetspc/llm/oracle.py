"""The same results in DuckDB SQL, where SQL can express them."""

LINE_DEDUP = r"""
with recursive
lines as (
  select doc_id, unnest(range(len(parts))) as line_no, unnest(parts) as line
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents)
),
inked_lines as (select * from lines where regexp_matches(line, '[^\x20\x09-\x0D]')),
firsts as (
  select line, count(*) as copies, min({'d': doc_id, 'l': line_no}) as place from inked_lines group by line
),
-- An edit of a code point is at most four edits of bytes, which is what levenshtein counts. One edit
-- is allowed for every 16 characters of the shorter line.
pairs as (
  select a.line as x, b.line as y, a.place as px, b.place as py, least(2, length(b.line) // 16) as allowed
  from firsts a join firsts b on length(b.line) between length(a.line) - 2 and length(a.line) and a.line <> b.line
    and (length(b.line) < length(a.line) or b.line < a.line)
  where length(b.line) >= 16 and levenshtein(a.line, b.line) <= 8
),
-- Up to two edits: go past what both begin with, then spend an edit in one of three ways.
walk as (
  select x, y, x as a, y as b, 0 as spent, allowed from pairs
  union all
  select x, y, a[p + 1 + da:], b[p + 1 + db:], spent + 1, allowed
  from (
    select *, coalesce(list_position(list_transform(range(1, least(length(a), length(b)) + 1), lambda i: a[i] <> b[i]), true) - 1,
                       least(length(a), length(b))) as p
    from walk where spent < allowed and a <> b
  ), (values (0, 1), (1, 0), (1, 1)) as ways(da, db)
),
near as (select distinct x, y from walk where a = b),
linked as (select px, py, pairs.x, pairs.y from near join pairs using (x, y)),
ends as (select x as line, py as other from linked union all select y, px from linked),
links as (select line, count(*) as n_links, min(other) as other from ends group by line),
marks as (
  select l.doc_id, l.line_no, coalesce(n.n_links, 0) as n_links,
    {'d': l.doc_id, 'l': l.line_no} <> f.place or coalesce(n.other < f.place, false) as dropped
  from inked_lines l join firsts f using (line) left join links n using (line)
),
per_doc as (
  select doc_id, count(*) filter (dropped) as n_dropped, sum(n_links) as n_links,
    string_agg(line_no::varchar, ',' order by line_no) filter (dropped) as dropped
  from marks group by doc_id
)
select d.doc_id, (select count(*) from lines l where l.doc_id = d.doc_id) as n_lines,
  coalesce(n_dropped, 0) as n_dropped, coalesce(n_links, 0)::bigint as n_links, coalesce(dropped, '') as dropped
from documents d left join per_doc p using (doc_id)
"""

# What is escaped gets one character more; marks, roles and texts are counted as they stand.
CHAT_FORMAT = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
escaped as (
  select *, lag(role) over w as before,
    length(regexp_replace(regexp_replace(text, '\[(~*(?:INST\]|/INST\]|ANS\]|NEXT\]))', '[~\1', 'g'), '<(~*(?:s>|/s>))', '<~\1', 'g')) as n_text,
    length(regexp_replace(regexp_replace(role, '\[(~*(?:INST\]|/INST\]|ANS\]|NEXT\]))', '[~\1', 'g'), '<(~*(?:s>|/s>))', '<~\1', 'g')) as n_role
  from turns window w as (partition by conv_id order by turn, role, text)
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(n_text + case when before is not distinct from role then length('[NEXT]')
      else length('<s>') + n_role + case when role = 'assistant' then length('[ANS]</s>') else length('[INST][/INST]') end end)::bigint as formatted_chars
from escaped group by conv_id
"""

MIXTURE = r"""
with sizes as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    (('0x' || md5(coalesce(doc_id::varchar, '') || '|mix-1|' || coalesce(text, ''))[1:13])::bigint::double + 0.5) / 4503599627370496.0 as u,
    row_number() over (partition by doc_id, text, source) as twin
  from documents
),
sources as (
  select source, sum(size)::bigint as source_size, 2 * sum(size)::double as most,
    [3.0, 1.0, 2.0][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as weight
  from sizes group by source
),
-- The sources that stop are the first in the order of size over weight.
ranked as (
  select *, 1.5 * sum(source_size) over () - coalesce(sum(most) over before, 0.0) as words,
    sum(weight) over () - coalesce(sum(weight) over before, 0.0) as weights
  from sources
  window before as (order by most / weight, source nulls last rows between unbounded preceding and 1 preceding)
),
level as (
  select words, weights from ranked where most * weights > weight * words order by most / weight, source nulls last limit 1
),
targets as (
  select r.source, source_size,
    case when most * r.weights <= weight * r.words then most else weight * l.words / l.weights end as target
  from ranked r left join level l on true
),
classes as (
  select source, length(bin(size)) as weight, sum(size)::bigint as words from sizes group by all
),
-- Expected copies are level * weight, 2 at most; classes of great weight stop first.
levels as (
  select c.*, source_size, target, (target - 2 * coalesce(sum(words) over before, 0)) / nullif(sum(weight * words) over rest, 0) as level
  from classes c join targets t on c.source is not distinct from t.source
  window before as (partition by c.source order by weight desc rows between unbounded preceding and 1 preceding),
    rest as (partition by c.source order by weight desc rows between current row and unbounded following)
),
expected as (
  select *, case when source_size > 0 then least(2.0, weight * coalesce(
      arg_max(level, weight) filter (where level * weight < 2) over (partition by source), 2.0)) else 0.0 end as copies
  from levels
),
chances as (
  select *, floor(copies) as certain, copies - floor(copies) as chance, target - sum(floor(copies)::bigint * words) over (partition by source) as wanted
  from expected
),
docs as (
  select s.*, source_size, target, certain, wanted,
    case when chance > 0 and size > 0 then (u / (1 - u)) / (chance / (1 - chance)) end as place
  from sizes s join chances c on s.source is not distinct from c.source and length(bin(s.size)) = c.weight
),
-- Equal rows follow each other, so each is taken if more than half of it is still wanted.
summed as (
  select *, sum(size) over (partition by source, place is null order by place, size, twin) as up_to from docs
)
select doc_id, size, source_size, target,
  (certain * size + case when place is not null and up_to - size / 2 <= wanted then size else 0 end)::bigint as taken
from summed
"""

DIVERGENCE = r"""
with docs as (
  select row_number() over () as d, coalesce(lang, '') as lang, coalesce(source, '') as source,
    list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'),
      lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as words
  from documents
),
tokens as (select lang, source, d, unnest(words) as term from docs),
kept as (select lang, term, count(*) as lang_n from tokens group by lang, term having count(distinct d) >= 30),
langs as (select lang, count(*) as v, sum(lang_n) as total from kept group by lang),
groups as (select distinct lang, source from docs),
counts as (select lang, source, term, count(*) as n from tokens semi join kept using (lang, term) group by lang, source, term),
totals as (select lang, source, sum(n) as total from counts group by lang, source),
cells as (
  select g.lang, g.source, k.term, coalesce(n, 0) as n,
    (1 + 1000000000::hugeint * (coalesce(n, 0) + 5) // (coalesce(t.total, 0) + 5 * v))::bigint as p,
    (1 + 1000000000::hugeint * (lang_n + 5) // (l.total + 5 * v))::bigint as q
  from groups g join kept k using (lang) join langs l using (lang) left join totals t using (lang, source)
    left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term
),
apart as (
  select a.lang, a.source, b.source as item, sum(abs(a.p - b.p))::bigint as value
  from cells a join cells b using (lang, term) group by a.lang, a.source, b.source
),
pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
    left join apart x on x.lang = a.lang and x.source = a.source and x.item = b.source
),
terms as (select lang, source, 'term' as part, term as item, p - q as value from cells where n > 0 and p > q)
select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank
from (select * from pairs union all select * from terms)
qualify part = 'pair' or rank <= 50
"""

PREFIX_TRIE = r"""
with turns as (
  select conv_id, coalesce(role, '') as r, coalesce(text, '') as x,
    row_number() over (partition by conv_id order by turn nulls first, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as place
  from conversations where conv_id is not null
),
own as (
  select conv_id, list({'r': r, 'x': x} order by place) as turns,
    -- CRC-32 bit by bit over the digits of the id.
    xor(4294967295, list_reduce([4294967295::bigint] || list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint),
      lambda s, b: list_reduce([xor(s, b)] || [0::bigint, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1))))) % 4 as h
  from turns group by conv_id
),
rebuilt as (
  select a.conv_id, coalesce(b.turns[1:a.h], []) || a.turns[a.h + 1:] as turns
  from own a left join own b on b.conv_id = a.conv_id - a.conv_id % 20
),
nodes as (
  select turns[1:d] as prefix, d as depth, min(conv_id) as conv_id, count(*) as n_convs,
    string_agg(conv_id::varchar, ',' order by conv_id) filter (d = len(turns)) as ending,
    len(regexp_extract_all(coalesce(turns[1:d][-1].x, ''), '[^\x20\x09-\x0D]+')) as words
  from (select *, unnest(range(len(turns) + 1)) as d from rebuilt) group by turns[1:d], d, turns[1:d][-1].x
),
children as (select prefix[1:depth - 1] as prefix, depth - 1 as depth, count(*) as n_children from nodes where depth > 0 group by all),
counted as (select *, coalesce(n_children, 0) as kids from nodes left join children using (prefix, depth)),
below as (
  select prefix[1:k] as prefix, k as depth, count(*) filter (kids = 0) as n_leaves, sum((n_convs - 1) * words)::bigint as saved_tokens
  from (select *, unnest(range(depth + 1)) as k from counted) group by all
)
select c.conv_id, c.depth, p.conv_id as parent_conv_id, c.n_convs, c.kids as n_children, n_leaves, saved_tokens,
  sha256(coalesce(c.ending, '')) as ends_sha256
from counted c join below using (prefix, depth)
  left join nodes p on p.depth = c.depth - 1 and p.prefix = c.prefix[1:c.depth - 1]
"""

ORACLE = {
    "op1_line_dedup": LINE_DEDUP, "op3_chat_format": CHAT_FORMAT, "op5_mixture": MIXTURE,
    "op11_prefix_trie": PREFIX_TRIE, "op13_source_divergence": DIVERGENCE,
}
