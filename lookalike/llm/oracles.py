"""SQL twins of the operators that SQL can express."""

_TERMS = r"""regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

SEARCH = f"""
with docs as (select row_number() over () as r, doc_id, {_TERMS} as words from documents),
items as (select row_number() over () as i, item_id, {_TERMS} as words from benchmark),
sized as (select r, doc_id, len(words)::bigint as n from docs where len(words) > 0),
corpus as (select count(*)::bigint as docs, sum(n)::bigint as total from sized),
counts as (
  select r, term, count(*)::bigint as tf
  from (select r, unnest(words) as term from docs) group by r, term),
wanted as (
  select i, term, count(*)::bigint as times
  from (select i, unnest(words) as term from items) group by i, term),
weights as (
  select term, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w
  from counts, corpus where term in (select term from wanted) group by term),
factors as (select r, doc_id, 100 - 75 + (75 * n * docs) // total as m from sized, corpus),
scores as (
  select i, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score, any_value(doc_id) as doc_id
  from wanted join counts using (term) join weights using (term) join factors using (r)
  group by i, r),
ranked as (
  select i, doc_id, score, row_number() over (partition by i order by score desc, doc_id nulls last, r) as "rank"
  from scores where score > 0)
select item_id, "rank"::integer as "rank", doc_id, score
from ranked join items using (i) where "rank" <= 10
"""

_BITS = """flatten(list_transform(
      flatten(list_transform(string_split(coalesce(doc_id::varchar, '') || ':' || run, ''), lambda ch:
        case when unicode(ch) < 128 then [unicode(ch)] else [192 + (unicode(ch) >> 6), 128 + (unicode(ch) & 63)] end)),
      lambda byte: list_transform(range(8), lambda k: (byte >> k) & 1)))"""

SPELLING = f"""
with recursive runs as (
  select doc_id, run, count(*) as times
  from (select doc_id, unnest(regexp_extract_all(
          translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) as run
        from documents)
  where length(run) >= 5
  group by doc_id, run),
hashed as (
  select run, times, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, {_BITS}::bigint[]),
      lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1)))) as h
  from runs),
spelled as (
  select times, case when h % 97 = 0
      then substr(run, 1, (h % length(run))::integer) || substr(run, (h % length(run))::integer + 2) else run end as word
  from hashed),
words as (
  select word, sum(times)::bigint as n from spelled where length(word) >= 5 group by word having sum(times) >= 3),
cuts as (
  select word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) as rest
  from (select word, n, unnest(range(1, length(word) + 1))::integer as p from words)),
near as (
  select a.word, b.word as other, b.n as other_n from cuts a join cuts b on a.rest = b.rest and a.p = b.p and a.word <> b.word
  union select a.word, b.word, b.n from words a join cuts b on a.word = b.rest
  union select b.word, a.word, a.n from words a join cuts b on a.word = b.rest),
best as (
  select word, count(*)::bigint as n_near, arg_min(other, (-other_n, other)) as other, max(other_n) as other_n
  from near group by word),
formed as (
  select word, n, coalesce(n_near, 0)::bigint as n_near,
    case when other_n >= 2 * n then other end as form, case when other_n >= 2 * n then other_n end as form_n
  from words left join best using (word)),
chains as (
  select word, word as root, form as onward from formed
  union all
  select chains.word, formed.word, formed.form from chains join formed on formed.word = chains.onward)
select formed.word, n, n_near, form, form_n, root
from formed join chains on chains.word = formed.word and chains.onward is null
"""
