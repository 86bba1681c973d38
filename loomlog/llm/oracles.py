"""DuckDB SQL for the queries that SQL can express."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def quality_sql(alpha: float = 0.05, delta: float = 0.05) -> str:
    from loomlog.llm.quality_rules import CUTOFFS, RULES

    metrics = ", ".join(f"('{r}', {r})" for r in RULES)
    rate = alpha / len(RULES)
    return rf"""
with docs as (
  select doc_id, coalesce(lang, '') as lang, coalesce(text, '') as text, {WORDS} as words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from documents),
spots as (select doc_id, words, unnest(range(1, len(words) - 6)) as i from docs),
twice as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, words[i:i+7]) as c from spots) where c > 1),
covered as (
  select doc_id, sum(least(8, coalesce(after - i, 8))) as n from (select doc_id, i, lead(i) over (partition by doc_id order by i) as after from twice) group by 1),
base as (
  select doc_id, lang, len(words) as n_words, len(lines) as n_lines,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
    len(lines) - len(list_distinct(lines)) as n_dup_lines,
    coalesce(n, 0)::bigint as n_repeat_words,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) as n_upper,
    len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i-1])) as n_stutter
  from docs left join covered using (doc_id)),
figures as (
  select *, 1000 * n_symbols // greatest(word_chars, 1) as symbol_permille, 1000 * n_upper // greatest(word_chars, 1) as upper_permille,
    1000 * n_dup_lines // greatest(n_lines, 1) as dup_line_permille, 1000 * n_repeat_words // greatest(n_words, 1) as repeat_permille,
    1000 * n_stutter // greatest(n_words, 1) as stutter_permille from base),
good as (select doc_id from labels group by 1 having min(coalesce(quality, 0)) = 1),
cuts as (select unnest({list(CUTOFFS)}) as cutoff),
long as (select f.doc_id, lang, m.rule, m.value from figures f, lateral (values {metrics}) m(rule, value)),
counts as (
  select lang, rule, cutoff, count(*) as n, count(*) filter (value >= cutoff) as k
  from long join good using (doc_id), cuts group by all),
tests as (
  select *, case when k >= n * {rate!r} then 1.0 else list_sum(list_transform(range(0, k + 1), lambda j:
      exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({rate!r}) + (n - j) * ln(1 - {rate!r})))) end as p from counts),
sequence as (
  select *, bool_and(p <= {delta!r} / ({len(RULES)} * (select count(distinct lang) from counts))) over (partition by lang, rule order by cutoff desc) as passes from tests),
limits as (select lang, rule, min(cutoff) as cutoff from sequence where passes group by all),
bad as (select distinct doc_id from long join limits using (lang, rule) where value >= cutoff),
verdict as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from figures)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and doc_id not in (select doc_id from bad) as kept from verdict"""


def secrets_sql(most_owners: int = 2, most_repositories: int = 4) -> str:
    from loomlog.llm.secret_scan import PATTERNS

    quoted = {k: p.replace("'", "''") for k, p in PATTERNS.items()}
    parts = " union all ".join(
        f"""
  select doc_id, owner, repository, {no} as kind, '{kind}' as name, i, regexp_extract_all(text, '{p}')[i] as match,
    list_sum(list_transform(string_split_regex(text, '{p}')[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(text, '{p}')[1:i-1], lambda x: length(x))), 0) as start
  from (select *, unnest(range(1, len(regexp_extract_all(text, '{p}')) + 1)) as i from docs)"""
        for no, (kind, p) in enumerate(quoted.items())
    )
    return rf"""
with docs as (select doc_id, coalesce(source, '') as owner, concat(source, chr(0), lang) as repository, coalesce(text, '') as text from documents),
matches as ({parts}),
candidates as (
  select *, start + length(match) as stop, case when kind = 0 then regexp_extract(match, '{quoted["assign"]}', 2) else match end as value from matches),
passing as (
  select * from candidates where kind = 0 and length(value) >= 6 or kind = 1 and length(value) >= 20 or kind = 2
    or kind = 3 and regexp_matches(value, '[0-9]') and regexp_matches(value, '[A-Z]') and regexp_matches(value, '[a-z]')),
apart as (
  select * from passing p where kind < 3 or not exists (
    select 1 from passing b where b.doc_id = p.doc_id and b.kind < 3 and b.start < p.stop and b.stop > p.start)),
owners as (select value, count(distinct owner) <= {most_owners} and count(distinct repository) <= {most_repositories} as live from apart group by 1),
spans as (select a.*, live, format('{{}}:{{}}:{{}}', name, start, stop) as written from apart a join owners using (value)),
per_doc as (
  select doc_id, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
    string_agg(written, ',' order by start, kind) filter (kind < 3) as base, string_agg(written, ',' order by start, kind) filter (kind < 3 or live) as spans,
    count(*) filter (live) as n_owner_specific, count(*) filter (not live) as n_widely_copied from spans group by 1)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256,
  coalesce(spans, '') as spans, coalesce(n_owner_specific, 0) as n_owner_specific, coalesce(n_widely_copied, 0) as n_widely_copied
from docs left join per_doc using (doc_id)"""


def token_counts_sql() -> str:
    words = r"len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))"
    marks = r"len(regexp_extract_all(text, '[A-Za-z0-9\x{80}-\x{10FFFF}]+|[^A-Za-z0-9\x{80}-\x{10FFFF}\x00-\x20]'))"
    return rf"""
with docs as (select source, lang, coalesce(text, '') as text from documents),
counted as (
  select source, lang, 'words-1' as tokenizer_version, {words} as n from docs
  union all select source, lang, 'marks-1', {marks} from docs)
select source, lang, tokenizer_version, count(*) as n_docs, sum(n)::bigint as n_tokens from counted group by all"""


def licenses_sql(dice: float = 0.8) -> str:
    from loomlog.llm.licenses import TEMPLATES

    rows = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, forms in TEMPLATES.items() for text in forms)
    words = r"regexp_extract_all(lower({}), '[a-z0-9.]*[a-z0-9]+')"
    grams = "case when len(w) < 2 then w else list_distinct(list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1]))) end"
    return rf"""
with forms as (select license, text, {grams} as g from (select license, text, {words.format("text")} as w from (values {rows}) t(license, text))),
lines as (
  select doc_id, 0 as unit, coalesce(text, '') as line from documents
  union all select doc_id, i, string_split(coalesce(text, ''), chr(10))[i] from (
    select doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) as i from documents)),
units as (select doc_id, unit, {grams} as g from (select doc_id, unit, {words.format("line")} as w from lines)),
scored as (
  select doc_id, unit, license, 2 * len(list_intersect(u.g, f.g)) / (len(u.g) + len(f.g)) as dice
  from units u join forms f on len(u.g) > 0 and len(u.g) between len(f.g) * {dice} / {2 - dice} - 1 and len(f.g) * {2 - dice} / {dice} + 1)
select doc_id, license, unit, dice from scored where dice >= {dice}
qualify row_number() over (partition by doc_id, license order by dice desc, unit) = 1"""


def jaccard_sql() -> str:
    """Classes of equal sets, links by counts of shared shingles, the least id reachable."""
    return r"""
with recursive texts as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (
  select doc_id, list_sort(case when len(w) > 2 then list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from texts),
classes as (select s, len(s) as n, min(doc_id) as id from sets where len(s) > 0 group by s),
grams as (select id, n, unnest(s) as g from classes),
pairs as (select a.id as a, b.id as b, a.n as an, b.n as bn, count(*) as c from grams a join grams b on a.g = b.g and a.id < b.id and 100 * a.n >= 90 * b.n and 100 * b.n >= 90 * a.n group by all),
links as (select a, b from pairs where 100 * c >= 90 * (an + bn - c)),
reach as (
  select id, id as root from classes
  union select l.b, r.root from reach r join (select a, b from links union all select b, a from links) l on l.a = r.id),
least as (select id, min(root) as root from reach group by id)
select doc_id, len(sets.s)::bigint as n_shingles, coalesce(root, doc_id) as component_id from sets left join classes on sets.s = classes.s left join least using (id)"""


def repair_sql() -> str:
    """A pass over rows and states; inserting is left out, because deleting the inserted row's partner, and a system row left alone, is always cheaper."""
    return r"""
with recursive hashed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    xor(list_reduce(list_concat([4294967295::ubigint], list_transform(string_split(concat(coalesce(conv_id::varchar, ' '), ':', coalesce(turn::varchar, ' ')), ''), lambda x: ord(x)::ubigint)),
      lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)::ubigint[]), lambda x, i: xor(x >> 1, 3988292384::ubigint * (x & 1)))), 4294967295::ubigint) % 20 as k from conversations),
damaged as (
  select conv_id, turn, case when k = 4 then 'user' else role end as role, case when k = 1 then '' when k = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(range(case when k = 3 then 2 else 1 end)) as again from hashed where k <> 0),
numbered as (
  select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from damaged),
told as (select *, row_number() over (partition by conv_id, role, text order by i) as same from numbered),
faults as (
  select *, left(role, 1) as r, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank' when same > 1 then 'duplicate'
      when right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
    lag(left(role, 1)) over (partition by conv_id order by i) as before from told),
counts as (
  select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
    count(*) filter (fault = 'truncated') as truncated, count(*) filter (before is not null and before || r not in ('su', 'ua', 'au')) as illegal from faults group by conv_id),
moves(q, r, p) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
edits as (
  select f.conv_id, f.i, q.q, e.* from faults f, (values (0), (1), (2), (3)) q(q), lateral (
    select 'D' as edit, 2 as cost, q.q as p, null as said
    union all select 'R', 1 + case when fault = 'truncated' then 5 else 0 end, case when q.q = 2 then 3 else 2 end, concat(case when q.q = 2 then 'assistant' else 'user' end, ':', text) where fault not in ('blank', 'duplicate')
    union all select 'K', case when fault = 'truncated' then 5 else 0 end, m.p, concat(role, ':', text) from moves m where m.q = q.q and m.r = f.r and fault not in ('blank', 'duplicate')) e),
best as (
  select conv_id, 0::bigint as i, 0 as q, {'cost': 0, 'audit': ''} as w, null::varchar as said from counts
  union all
  select b.conv_id, b.i + 1, e.p, min({'cost': b.w.cost + e.cost, 'audit': b.w.audit || e.edit}), arg_min(nullif(concat_ws(chr(10), b.said, e.said), ''), {'cost': b.w.cost + e.cost, 'audit': b.w.audit || e.edit})
  from best b join edits e on e.conv_id = b.conv_id and e.i = b.i + 1 and e.q = b.q group by b.conv_id, b.i, e.p),
done as (select b.conv_id, min(w) as w, arg_min(coalesce(said, ''), w) as said from best b join counts c on c.conv_id = b.conv_id and c.n = b.i where q in (0, 3) group by b.conv_id)
select conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
  coalesce(w.cost, 0)::bigint as cost, coalesce(w.audit, '') as audit, sha256(coalesce(said, '')) as repaired_sha256
from (select distinct conv_id from conversations) left join counts using (conv_id) left join done using (conv_id)"""
