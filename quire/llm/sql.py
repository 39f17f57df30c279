"""DuckDB SQL with the rows of this subpackage's queries, where SQL can express them.

Scores of trained models, hashed fingerprints, keyed permutations and tokenizers have no SQL form; their tests hold the queries
against brute force, exact round trips or held-out accuracy.
"""

from __future__ import annotations

from quire.llm.quality import STOP_WORDS

_WORD = r"[^\x20\x09-\x0D]+"
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)

#: The base columns by contract; the verdict by the production table of thresholds.
OP8 = rf"""
with w as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{_WORD}') as words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents
), m as (
  select doc_id, words, cast(len(words) as bigint) as n_words, cast(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) as bigint) as word_chars,
    cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, len(lines) as n_lines,
    cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, len(list_filter(words, lambda x: lower(x) in ({_STOP}))) as n_stop
  from w
), g as (
  select doc_id, unnest(range(1, len(words) - 1)) as i, unnest(list_transform(range(1, len(words) - 1), lambda i: concat(words[i], ' ', words[i + 1], ' ', words[i + 2]))) as gram
  from w where len(words) > 2
), again as (
  select doc_id, i from (select *, count(*) over (partition by doc_id, gram) as n from g) where n > 1
), covered as (
  select doc_id, count(*) as n from (select doc_id, i from again union select doc_id, i + 1 from again union select doc_id, i + 2 from again) group by doc_id
), b as (
  select m.*, cast(coalesce(c.n, 0) as bigint) as n_repeat_words, n_words < 50 or 100 * coalesce(c.n, 0) > 50 * n_words as base_failed, greatest(n_words, 1) as d
  from m left join covered c using (doc_id)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and word_chars / d between 2 and 12 and n_symbols / d <= 0.1 and n_stop / d >= 0.02 and n_dup_lines / greatest(n_lines, 1) <= 0.5 and n_repeat_words / d <= 0.5 as kept
from b
"""

#: The shuffle key is an md5 of the id, which both engines have; the rest is windows over all rows.
OP10 = rf"""
with d as (
  select doc_id, source, md5('mix:' || coalesce(cast(doc_id as varchar), 'null')) as key, cast(coalesce(len(regexp_extract_all(text, '{_WORD}')), 0) as bigint) as size from documents
), s as (
  select source, cast(sum(size) as bigint) as source_size, 1 + (row_number() over (order by source is null, source) - 1) % 3 as weight from d group by source
), c as (
  select *, 3 * source_size as cap, sum(source_size) over () as total, coalesce(sum(3 * source_size) over (order by 3 * source_size / weight, source rows between unbounded preceding and 1 preceding), 0) as before,
    sum(weight) over (order by 3 * source_size / weight, source rows between current row and unbounded following) as rest from s
), l as (
  select *, (total - before) / rest as share from c
), z as (
  select *, (select first(share order by cap / weight, source) from l where cap / weight >= share) as level from l
), t as (
  select source, source_size, total, least(cast(cap as double), coalesce(level * weight, cap)) as target from z
), r as (
  select d.*, t.source_size, t.target, t.total, row_number() over (order by d.source, key, size) as id,
    sum(size) over (partition by d.source order by key, size rows unbounded preceding) as sent from d join t on d.source is not distinct from t.source
), e as (
  select id, size, total, sum(size) over (order by (k * source_size + sent) / target, source is null desc, source, key, size, k rows unbounded preceding) as running
  from r, (values (0), (1), (2)) v(k) where size > 0 and target > 0
), x as (
  select id, sum(size) as taken from e where running <= total group by id
)
select doc_id, size, source_size, target, cast(coalesce(taken, 0) as bigint) as taken from r left join x using (id)
"""

#: Counts of documents by the set of filters they fail give every step of every order.
OP12 = rf"""
with w as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{_WORD}') as words from documents
), c as (
  select text, min(doc_id) as least from w group by text
), f as (
  select w.doc_id, part, len(words) < 100 as a, 100 * len(list_distinct(words)) < 80 * len(words) as b, 100 * (length(w.text) - length(regexp_replace(w.text, '[A-Z]', '', 'g'))) > 10 * length(w.text) as c,
    regexp_matches(w.text, '[#$%&*|]') as d, coalesce(w.doc_id > c.least, false) as e
  from w join c on w.text = c.text
), l as (
  select doc_id, max(cast(quality = 1 as int)) as good, max(cast(toxic = 1 as int)) as bad from labels group by doc_id
), m as (
  select part, a::int + 2 * b::int + 4 * c::int + 8 * d::int + 16 * e::int as failed, coalesce(good, 0) as good, coalesce(bad, 0) as bad, count(*) as n from f left join l using (doc_id) group by all
), x(letter, bit) as (
  values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), o as (
  select concat(p.letter, q.letter, r.letter, s.letter, t.letter) as filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] as bits
  from x p, x q, x r, x s, x t where p.bit + q.bit + r.bit + s.bit + t.bit = 31 and (p.bit | q.bit | r.bit | s.bit | t.bit) = 31
), s as (
  select filter_order, step, bits[step] as bit, coalesce(list_sum(bits[1:step - 1]), 0)::int as before from o, range(1, 6) g(step)
), z as (
  select p.part, filter_order, step, bit,
    coalesce(sum(n) filter ((failed & (before | bit)) = 0), 0) as kept, coalesce(sum(n) filter ((failed & before) = 0 and (failed & bit) > 0), 0) as removed,
    coalesce(sum(n) filter ((failed & before) > 0 and (failed & bit) > 0), 0) as redundant, coalesce(sum(n) filter (failed = bit), 0) as unique_fails,
    coalesce(sum(n * good) filter ((failed & before) = 0 and (failed & bit) > 0), 0) as good_lost, coalesce(sum(n * bad) filter ((failed & before) = 0 and (failed & bit) > 0), 0) as toxic_lost
  from s, (select distinct part from m) p left join m on m.part = p.part group by all
)
select part, filter_order, cast(step as int) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
  cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, bit) as bigint) as shapley
from z
"""

#: Paths are the digests of their turns, one after another, so a node's ancestors are prefixes of its path; crc32 bit by bit.
OP13 = r"""
with t as (
  select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, '')) as rank, concat(md5(coalesce(role, '')), md5(coalesce(text, ''))) as x, length(coalesce(text, '')) as chars
  from conversations where conv_id is not null
), c as (
  select c, c - c % 100 as head, count(*) as n,
    xor(list_reduce(list_concat([cast(4294967295 as bigint)], list_transform(string_split(cast(c as varchar), ''), lambda x: cast(ascii(x) as bigint))),
      lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: case when y & 1 = 1 then xor(y >> 1, cast(3988292384 as bigint)) else y >> 1 end)), cast(4294967295 as bigint)) % 6 as h
  from t group by c
), r as (
  select c.c, 0 as part, rank, x, chars from c join t on t.c = c.head and rank <= h
  union all select c.c, 1, rank, x, chars from c join t on t.c = c.c and rank > h
), p as (
  select c, row_number() over w as depth, string_agg(x, '') over w as path, chars from r window w as (partition by c order by part, rank rows unbounded preceding)
  union all select c, 0, '', 0 from c
), n as (
  select path, min(c) as conv_id, any_value(depth) as depth, count(*) as n_convs, any_value(chars) as chars from p group by path
), k as (
  select left(path, 64 * (depth - 1)) as path, count(*) as n_children from n where depth > 0 group by all
), s as (
  select left(n.path, 64 * d) as path, count(*) filter (k.path is null) as n_leaves, sum((n_convs - 1) * chars) as saved_tokens from n left join k on k.path = n.path, lateral unnest(range(0, depth + 1)) u(d) group by all
), e as (
  select path, string_agg(cast(c as varchar), ',' order by c) as ids from (select c, arg_max(path, depth) as path from p group by c) group by path
)
select n.conv_id, cast(n.depth as bigint) as depth, q.conv_id as parent_conv_id, n.n_convs, coalesce(n_children, 0) as n_children, n_leaves, cast(saved_tokens as bigint) as saved_tokens, sha256(coalesce(ids, '')) as ends_sha256
from n left join n q on n.depth > 0 and q.path = left(n.path, 64 * (n.depth - 1)) left join k on k.path = n.path join s on s.path = n.path left join e on e.path = n.path
"""

ORACLE: dict[str, str] = {"op8_quality": OP8, "op10_mix": OP10, "op12_interaction": OP12, "op13_trie": OP13}
