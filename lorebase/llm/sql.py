"""SQL that gives the rows of the queries, for DuckDB."""

from lorebase.llm.quality_rules import STOP_FORMS, THRESHOLDS
from lorebase.llm.secret_scan import ACCESS, ALLOWED, ASSIGN, ASSIGN_VALUE, CANDIDATE, CLASSES, HEX, IN_URL, N_LOG_N, WINDOW
from lorebase.llm.url_filter import LISTED_HOSTS

TOP_K = """
with v as (
    select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as e from embeddings
    where vec_id is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scores as (
    select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
    from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e)
    where q.vec_id % 100 = 0
), ranked as (
    select *, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank from scores
)
select query_id, rank, vec_id, score from ranked where rank <= 10
"""

URL_FILTER = """
with cut as (
    select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), parts as (
    select page_id,
        translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
    from cut
), rules(verdict, rhost, rpath) as (
    values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), listed(lhost) as (values %s
), fits as (
    select page_id, arg_max(rhost || rpath, length(rhost || rpath)) as rule, arg_max(verdict, length(rhost || rpath)) as verdict
    from parts join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
    group by page_id
)
select p.page_id, host, path, rule,
    coalesce(f.verdict, case when exists (select 1 from listed where host = lhost or ends_with(host, '.' || lhost)) then 'block' else 'allow' end) as verdict
from parts p left join fits f using (page_id)
""" % ", ".join(f"('{h}')" for h in LISTED_HOSTS)


def _broken(r) -> str:
    ratio = f"{r.top}::double / " + ("1.0" if r.bottom is None else f"greatest({r.bottom}, 1)")
    out = [x for x in (f"{ratio} < {r.low}" if r.low is not None else "", f"{ratio} > {r.high}" if r.high is not None else "") if x]
    return f"when n_words >= {r.min_words} and ({' or '.join(out)}) then '{r.name}'"


QUALITY_RULES = r"""
with t as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from t),
places as (select doc_id, array_to_string(ws[i:i + 4], ' ') as win, i from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from w)),
twice as (select doc_id, i from (select *, count(*) over (partition by doc_id, win) as n from places) where n > 1),
repeated as (select doc_id, count(distinct i + k) as n from twice, (select unnest(range(5)) as k) group by doc_id),
counts as (
    select doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
        length(regexp_replace(text, '[^#*$%%&|<>]+', '', 'g'))::bigint as n_symbols,
        (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words,
        (length(text) - length(replace(text, '!', '')))::bigint as n_marks, len(ls)::bigint as n_lines,
        len(list_filter(ws, lambda x: list_contains([%s], x)))::bigint as n_stop_words
    from w left join repeated using (doc_id)
), judged as (
    select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from counts
), named as (
    select *, case when base_failed then 'base' %s end as broken from judged
)
select *, broken is null as kept from named
""" % (", ".join(f"'{w}'" for w in STOP_FORMS), " ".join(_broken(r) for r in THRESHOLDS))

FILTER_AUDIT = r"""
with texts as (
    select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents
), marks as (
    select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels where doc_id is not null group by doc_id
), failed as (
    select t.doc_id, part, coalesce(good, false) as good, coalesce(toxic, false) as toxic, map {
        'A': len(ws) < 100, 'B': 100 * len(list_distinct(ws)) < 80 * len(ws),
        'C': 100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text), 'D': regexp_matches(text, '[#$%&*|]'),
        'E': coalesce(t.doc_id, 9223372036854775807) > min(coalesce(t.doc_id, 9223372036854775807)) over (partition by text)
    } as fails
    from texts t left join marks m on t.doc_id = m.doc_id
), grouped as (
    select part, fails, good, toxic, count(*) as n from failed group by all
), letters(f) as (values ('A'), ('B'), ('C'), ('D'), ('E')),
orders as (
    select a.f || b.f || c.f || d.f || e.f as filter_order from letters a, letters b, letters c, letters d, letters e
    where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps as (
    select filter_order, step, substr(filter_order, step, 1) as filter, string_split(substr(filter_order, 1, step - 1), '') as earlier
    from orders, (select unnest(range(1, 6)) as step)
), rows as (
    select part, filter_order, step, filter, good, toxic, n, fails[filter] as fails_it,
        len(list_filter(earlier, lambda x: x <> '' and fails[x])) > 0 as gone,
        len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: fails[x])) = 1 as once
    from grouped, steps
), found as (
    select part, filter_order, step::int as step, filter,
        coalesce(sum(n) filter (not gone and not fails_it), 0)::bigint as kept,
        coalesce(sum(n) filter (not gone and fails_it), 0)::bigint as removed,
        coalesce(sum(n) filter (gone and fails_it), 0)::bigint as redundant,
        coalesce(sum(n) filter (fails_it and once), 0)::bigint as unique_fails,
        coalesce(sum(n) filter (not gone and fails_it and good), 0)::bigint as good_lost,
        coalesce(sum(n) filter (not gone and fails_it and toxic), 0)::bigint as toxic_lost
    from rows group by all
)
select f.*, (sum(removed) over (partition by part, filter))::bigint as shapley from found f
"""


def _literal(form: str) -> str:
    return "'" + form.replace("'", "''") + "'"


def _placed(form: str) -> str:
    """A subquery of the matches of a form with their places and the text before them."""
    form = _literal(form)
    return f"""(
        select doc, list_sum(list_transform(gaps[:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[:k - 1], lambda x: length(x))), 0) as start,
            ms[k] as m, gaps[k] as gap
        from (select doc, regexp_extract_all(text, {form}) as ms, string_split_regex(text, {form}) as gaps from texts where regexp_matches(text, {form})),
            unnest(range(1, len(ms) + 1)) as t(k))"""


SECRET_SCAN = f"""
with texts as (select row_number() over () as doc, doc_id, coalesce(text, '') as text from documents),
base as (
    select doc, 'assign' as kind, 0 as rank, start, start + length(m) as stop from {_placed(ASSIGN)} where length(regexp_extract(m, {_literal(ASSIGN)}, 2)) >= {ASSIGN_VALUE}
    union all select doc, 'access', 1, start, start + length(m) from {_placed(ACCESS)}
    union all select doc, 'hex', 2, start, start + length(m) from {_placed(HEX)}
), windows as (
    select doc, start, m, list_transform(range(1, length(m) - {WINDOW} + 2), lambda i: substr(m, i, {WINDOW})) as ws
    from {_placed(CANDIDATE)} where not regexp_matches(gap, {_literal(IN_URL)}) {" ".join(f"and not regexp_matches(m, {_literal(x)})" for x in ALLOWED.values())}
), sums as (
    select doc, start, m, list_min(list_transform(ws, lambda w: list_sum(list_transform(
        list_distinct(string_split(w, '')), lambda c: {N_LOG_N}[len(list_filter(string_split(w, ''), lambda x: x = c)) + 1])))) as least
    from windows
), spans as (
    select * from base
    union all
    select doc, 'entropy', 3, start, start + length(m) from sums s
    where least <= case {" ".join(f"when regexp_matches(m, {_literal(c.form)}) then {c.most()}" for c in CLASSES)} end
        and not exists (select 1 from base b where b.doc = s.doc and b.start < s.start + length(m) and s.start < b.stop)
), joined as (
    select doc, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
        count(*) filter (kind = 'entropy') as n_entropy,
        string_agg(kind || ':' || start::bigint || ':' || stop::bigint, ',' order by start, rank) filter (kind <> 'entropy') as base,
        string_agg(kind || ':' || start::bigint || ':' || stop::bigint, ',' order by start, rank) as spans
    from spans group by doc
)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
    coalesce(n_entropy, 0)::bigint as n_entropy, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from texts left join joined using (doc)
"""

COLLOCATIONS = r"""
with pieces as (
    select lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from (select coalesce(lang, 'und') as lang, coalesce(text, '') as text from documents)
), ws as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from pieces),
spans as (
    select lang, array_to_string(ws[i:i + m - 1], ' ') as phrase, m
    from (select lang, ws, m, unnest(range(1, len(ws) - m + 2)) as i from ws, (select unnest(range(1, 5)) as m))
), f as (select lang, phrase, m, count(*) as a from spans group by all having count(*) >= 30),
sizes as (select lang, sum(len(ws))::bigint as n from ws group by lang),
cut as (
    select c.lang, c.phrase, c.m, c.a, k, array_to_string(string_split(c.phrase, ' ')[:k], ' ') as x, array_to_string(string_split(c.phrase, ' ')[k + 1:], ' ') as y
    from f c, (select unnest(range(1, 4)) as k) where c.m > 1 and k < c.m
), scores as (
    select cut.lang, cut.phrase, cut.m, cut.a, k, x.a as l, y.a as r, ((2000000::hugeint * cut.a) // (x.a + y.a))::bigint as score
    from cut join f x on x.lang = cut.lang and x.phrase = cut.x join f y on y.lang = cut.lang and y.phrase = cut.y
), best as (select * from scores qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inside as (
    select lang, array_to_string(string_split(phrase, ' ')[i:i + s - 1], ' ') as phrase, max(a) as longer
    from (select lang, phrase, a, s, unnest(range(1, m - s + 2)) as i from f, (select unnest(range(2, 4)) as s) where s < m)
    group by 1, 2
)
select b.lang, row_number() over (partition by b.lang order by score desc, a desc, b.phrase) as rank, b.phrase, a, l, r, n, score, m::int as n_words
from best b join sizes using (lang) left join inside i on i.lang = b.lang and i.phrase = b.phrase
where longer is null or 100 * longer < 80 * a
qualify rank <= 2000
"""
