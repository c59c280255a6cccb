"""Queries of the corpus operators and the SQL that says the same, for __spark_entry__.py."""

from __future__ import annotations

from riskloom.llm import divergence, html_text, jaccard, language, line_dedup, mixing, passages, periodic, pii, quality_model, repeats, rules, subwords

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_html_text": html_text.op2_html_text,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_quality_classifier": quality_model.op4_quality_classifier,
    "op5_quality_rules": rules.op5_quality_rules,
    "op6_decontamination": passages.op6_decontamination,
    "op7_language_id": language.op7_language_id,
    "op8_repeated_passages": repeats.op8_repeated_passages,
    "op9_jaccard_join": jaccard.op9_jaccard_join,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_sentencepiece": subwords.op12_sentencepiece,
    "op13_source_divergence": divergence.op13_source_divergence,
}

_WS = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"
_TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LETTERS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLE = {
    "op3_mix_sources": f"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::bigint as size, ('0x' || substr(md5('mix-1:' || coalesce(doc_id::varchar, '')), 1, 15))::bigint as key from documents),
s0 as (select source, sum(size)::bigint as source_size from d group by source),
s1 as (select *, (case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end)::bigint as w, source_size * 3 as cap, sum(source_size) over ()::bigint as budget from s0),
s2 as (select *, (budget - coalesce(sum(cap) over before, 0))::double / (sum(w) over following)::double as level, cap::double / w::double as own from s1
  window before as (order by cap::double / w::double, source nulls last rows between unbounded preceding and 1 preceding), following as (order by cap::double / w::double, source nulls last rows between current row and unbounded following)),
s3 as (select *, max(case when level <= own then level end) over () as fill from s2),
s as (select source, source_size, budget, coalesce(case when own < fill then cap::double else w::double * fill end, 0) as target from s3),
q as (select d.*, s.source_size, s.target, s.budget, sum(size) over (partition by d.source order by key, doc_id rows unbounded preceding)::bigint as upto from d join s on d.source is not distinct from s.source),
e as (select *, epoch, (source_size * epoch + upto)::double / target as finish, source_size * epoch + upto <= target as fits from q, (select unnest([0, 1, 2]) as epoch)),
b as (select *, sum(size) over (order by fits desc, finish, source nulls last, epoch, key, doc_id rows unbounded preceding) as total from e where size > 0)
select q.doc_id, q.size, q.source_size, q.target, coalesce(t.taken, 0)::bigint as taken from q
left join (select doc_id, sum(size) as taken from b where fits or total <= budget group by doc_id) t using (doc_id)""",
    "op6_decontamination": f"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_TOKEN}') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_TOKEN}') as w from benchmark),
bl as (select item_id, w, least(len(w), 10) as n from b where len(w) > 0),
bw as (select item_id, n, unnest(range(1, len(w) - n + 2)) as i, w from bl),
win as (select distinct item_id, n, list_aggregate(w[i : i + n - 1], 'string_agg', ' ') as t from bw),
lens as (select distinct n from win),
dw as (select doc_id, lens.n, unnest(range(1, len(w) - lens.n + 2)) as i, w from d, lens where len(w) >= lens.n),
occ as (select dw.doc_id, dw.i, dw.n, list_aggregate(w[i : i + dw.n - 1], 'string_agg', ' ') as t from dw),
hit as (select occ.doc_id, occ.i, occ.n, win.item_id from occ join win on occ.n = win.n and occ.t = win.t),
pos as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from (select distinct doc_id, i, n from hit)) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item_id::varchar as item from hit) group by doc_id),
it as (select item_id, n, len(w) as words, unnest(range(0, len(w))) as ipos, unnest(w) as term from bl),
dt as (select doc_id, unnest(range(0, len(w))) as pos, unnest(w) as term from d),
fr as (select term, count(*) as freq from dt where term in (select term from it) group by term),
st as (select item_id, n, ipos, it.term, freq, unnest(range(greatest(0, ipos - n + 1), least(ipos, words - n) + 1)) as start from it left join fr on it.term = fr.term),
rk as (select *, row_number() over (partition by item_id, start order by freq nulls first, ipos) as r, max((freq is null)::int) over (partition by item_id, start) as missing from st),
an as (select item_id, start, ipos, term from rk where missing = 0 and r <= 2),
pr as (select distinct a.item_id, a.ipos as ai, a.term as ta, b.ipos as bi, b.term as tb from an a join an b on a.item_id = b.item_id and a.start = b.start and a.ipos < b.ipos),
po as (select doc_id, term, pos from dt where term in (select term from an)),
nr as (select distinct x.doc_id, item_id::varchar as item from pr join po x on x.term = ta join po y on y.term = tb and y.doc_id = x.doc_id and abs((y.pos - bi) - (x.pos - ai)) between 1 and 3),
ne as (select doc_id, count(*) as n_near, string_agg(item, ',' order by item) as near from nr group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated,
  coalesce(n_near, 0)::bigint as n_near, sha256(coalesce(near, '')) as near_sha256
from d left join pos using (doc_id) left join its using (doc_id) left join ne using (doc_id)""",
    "op9_jaccard_join": f"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_WORD}') as w from documents),
sh as (select doc_id, list_sort(list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [list_aggregate(w, 'string_agg', ' ')] else [list_aggregate(w[i : i + 4], 'string_agg', ' ') for i in range(1, len(w) - 3)] end)) as s from d),
cls as (select min(doc_id) as rep, s, len(s) as n from sh where len(s) > 0 group by s),
mem as (select sh.doc_id, cls.rep from sh join cls on sh.s = cls.s),
inv as (select rep, n, unnest(s) as t from cls),
common as (select t from inv group by t having count(*) > 1),
inv2 as (select inv.* from inv join common using (t)),
lk as (select a.rep as a, b.rep as b from inv2 a join inv2 b on a.t = b.t and a.rep <> b.rep group by a.rep, b.rep, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach as (select rep as v, rep as u from cls union select r.v, lk.b from reach r join lk on r.u = lk.a),
comp as (select v, min(u) as c from reach group by v)
select sh.doc_id, len(sh.s)::bigint as n_shingles, coalesce(comp.c, sh.doc_id) as component_id
from sh left join mem using (doc_id) left join comp on mem.rep = comp.v""",
    "op10_line_dedup": f"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
k as (select *, translate(regexp_replace(regexp_replace(line, '^{_WS}+', ''), '{_WS}+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
f as (select key, max(doc_id) as keeper from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5)
select k.doc_id, count(*)::bigint as n_lines, count(f.key) filter (where k.doc_id <> keeper)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where f.key is null or k.doc_id = keeper), '')) as kept_sha256
from k left join f on k.key = f.key group by k.doc_id""",
    "op5_quality_rules": f"""
with d as (select doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{_WORD}') as w from documents),
l as (select doc_id, source, unnest(string_split(text, chr(10))) as line from d),
lw as (select doc_id, source, line, lower(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) as norm, len(regexp_extract_all(line, '{_WORD}')) as n from l),
dup as (select doc_id, count(*) - count(distinct line) as n from lw where n > 0 group by doc_id),
h as (select source, count(*) as docs from documents group by source),
f as (select lw.source, norm from lw join h on lw.source is not distinct from h.source where n > 0 group by lw.source, norm, docs having count(distinct doc_id) > 20 and (count(distinct doc_id) > 0.05 * docs or count(distinct doc_id) > 5000)),
g as (select doc_id, sum(n) as gone from lw join f on lw.source is not distinct from f.source and lw.norm = f.norm where n > 0 group by doc_id),
win as (select doc_id, unnest(range(1, len(w) - 1)) as i, w from d where len(w) >= 3),
win2 as (select doc_id, i, w[i] as a, w[i + 1] as b, w[i + 2] as c from win),
rep as (select doc_id, i from win2 qualify count(*) over (partition by doc_id, a, b, c) > 1),
cov as (select doc_id, count(distinct i + o) as n from rep, (select unnest([0, 1, 2]) as o) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, length(regexp_replace(text, '{_WS}', '', 'g'))::bigint as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(dup.n, 0)::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words,
  len(w) < 50 or 100 * coalesce(cov.n, 0) > 50 * len(w) as base_failed,
  not (len(w) < 50 or 100 * coalesce(cov.n, 0) > 50 * len(w)) and len(w) - coalesce(gone, 0) >= 0.5 * len(w) as kept
from d left join dup using (doc_id) left join cov using (doc_id) left join g using (doc_id)""",
    "op13_source_divergence": f"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_LETTERS}') as w from documents),
t as (select r, lang, source, unnest(w) as term from d),
k as (select lang, term, count(*)::bigint as n from t group by lang, term having count(distinct r) >= 30),
s as (select distinct lang, source from d),
c as (select t.lang, t.source, t.term, count(*)::bigint as n from t join k on t.lang = k.lang and t.term = k.term group by t.lang, t.source, t.term),
v as (select lang, count(*)::hugeint as v, sum(n)::hugeint as total from k group by lang),
g as (select s.lang, s.source, coalesce(sum(c.n), 0)::hugeint as total from s left join c on s.lang = c.lang and s.source = c.source group by s.lang, s.source),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, (1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (g.total + 5 * v.v))::bigint as p, (1 + (1000000000::hugeint * (k.n + 5)) // (v.total + 5 * v.v))::bigint as q
  from g join k on g.lang = k.lang join v on g.lang = v.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
pr as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p))::bigint as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source),
pw as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(pr.value, 0) as value from s a join s b on a.lang = b.lang and a.source <> b.source left join pr on pr.lang = a.lang and pr.source = a.source and pr.item = b.source),
tm as (select lang, source, 'term' as part, term as item, p - q as value from p where n > 0 and p > q)
select lang, source, part, item, value, cast(row_number() over (partition by lang, source order by value desc, item) as int) as rank from pw
union all select * from (select lang, source, part, item, value, cast(row_number() over (partition by lang, source order by value desc, item) as int) as rank from tm) where rank <= 50""",
}
