"""DuckDB SQL for the operators that SQL can express, over the whole tables.

Language identification, token counts, toxicity, repeated byte strings and the randomness battery have none: they train
models, run a tokenizer, or need positions of bytes and matches. Tests hold them to plain Python versions.
"""

from __future__ import annotations

from .common import ITEM_WORD, UPPER, WORD
from .mixing import KEEP, MARGINS, ROUNDS, TEMPER
from .quality_rules import GRIDS, LEARN, STEPS

_LOWER = f"translate(text, '{UPPER}', '{UPPER.lower()}')"


def decontamination(n: int = 13) -> str:
    return f"""with iw as (select item_id::varchar as item, regexp_extract_all({_LOWER}, '{ITEM_WORD}') as w from benchmark where text is not null),
win as (select distinct item, l, unnest(list_transform(range(1, len(w) - l + 2), lambda i: w[i:i + l - 1])) as g from (select *, least(len(w), {n}) as l from iw where len(w) > 0)),
dw as (select doc_id, coalesce(regexp_extract_all({_LOWER}, '{ITEM_WORD}'), []) as w from documents),
sizes as (select distinct l from win),
pos as (select doc_id, l, unnest(range(1, len(w) - l + 2)) as i, unnest(list_transform(range(1, len(w) - l + 2), lambda i: w[i:i + l - 1])) as g from dw, sizes where len(w) >= l),
hits as (select doc_id, i, pos.l, item from pos join win on pos.g = win.g),
cover as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + l)) as p from hits) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct doc_id, item from hits) group by doc_id)
select dw.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256,
coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from dw left join cover using (doc_id) left join items using (doc_id)"""


def mixing() -> str:
    steps, last = [], "cells0"
    for i in range(ROUNDS):
        for m in MARGINS:
            steps.append(f"r{i}{m} as (select * replace (w * t_{m} / sum(w) over (partition by {m}) as w) from {last})")
            last = f"r{i}{m}"
    shares = ", ".join(f"s_{m} as (select {m}, pow(sum(n) / (select sum(n) from cells), {TEMPER}) as s from cells group by {m})" for m in MARGINS)
    targets = ", ".join(f"s_{m}.s / (select sum(s) from s_{m}) as t_{m}" for m in MARGINS)
    joins = " ".join(f"join s_{m} using ({m})" for m in MARGINS)
    return f"""with words as (select doc_id, coalesce(source, '') as source, coalesce(lang, '') as lang, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) as n_tokens, coalesce(len(string_split(text, chr(10))), 1) as n_lines from documents),
seen as (select doc_id, source, lang, case when n_tokens < 50 then 'short' when n_tokens < 12 * n_lines then 'list' when n_tokens > 1000 then 'long' else 'prose' end as topic, n_tokens::bigint as n_tokens from words),
cells as (select source, lang, topic, sum(n_tokens)::double as n from seen group by all having sum(n_tokens) > 0), {shares},
cells0 as (select cells.*, n / (select sum(n) from cells) as w, {targets} from cells {joins}),
{", ".join(steps)},
o as (select *, w / n as r, coalesce(sum(n) over f, 0) as nb, coalesce(sum(w) over f, 0) as wb from {last} window f as (order by w / n desc, source, lang, topic rows between unbounded preceding and 1 preceding)),
sc as (select arg_max(({KEEP} * (select sum(n) from o) - nb) / ((select sum(w) from o) - wb), r) as scale from o where ({KEEP} * (select sum(n) from o) - nb) / ((select sum(w) from o) - wb) * r < 1),
odds as (select source, lang, topic, least(1.0, w * scale / n) as p from o, sc)
select doc_id, source, lang, topic, n_tokens, round(coalesce(p, {KEEP}), 9) as probability, ('0x' || substr(md5(concat('mix:', doc_id)), 1, 8))::bigint / 4294967296.0::double < coalesce(p, {KEEP}) as sampled
from seen left join odds using (source, lang, topic)"""


def quality(risk: float = 0.02, delta: float = 0.05) -> str:
    value = {"symbols_per_word": "n_symbols / n_words", "repeat_share": "n_repeat_words / n_words", "dup_line_share": "n_dup_lines / n_lines", "longest_mean_word": "word_chars / n_words", "shortest_mean_word": "-(word_chars / n_words)"}
    values = " union all ".join(f"select doc_id, lang, '{rule}' as rule, ({value[rule].replace('/', '::double /')}) as v from c where n_words > 0" for rule in GRIDS)
    grid = ", ".join(f"('{rule}', {i}, {cut}::double)" for rule, cuts in GRIDS.items() for i, cut in enumerate(cuts))
    sizes = ", ".join(f"('{rule}', {len(cuts)})" for rule, cuts in GRIDS.items())
    tail = f"list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(m + 1) - lgamma(j + 1) - lgamma(m - j + 1) + j * ln({risk}) + (m - j) * ln(1 - {risk}))))"
    return f"""with t as (select doc_id, lang, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{WORD}') as w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) as l from documents),
g as (select doc_id, unnest(range(1, len(w) - 6)) as i, unnest(list_transform(range(1, len(w) - 6), lambda i: w[i:i + 7])) as g from t where len(w) >= 8),
again as (select doc_id, i from g qualify count(*) over (partition by doc_id, g) > 1),
rep as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 8)) as p from again) group by doc_id),
c as (select t.doc_id, lang, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
  len(l) as n_lines, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words from t left join rep using (doc_id)),
val as ({values}), grid(rule, i, cut) as (values {grid}),
sizes(rule, n) as (values {sizes}),
fails as (select val.doc_id, val.lang, val.rule, count(*) filter (v > cut) as f from val join grid using (rule) group by all),
good as (select doc_id, ('0x' || substr(md5(concat('quality:', doc_id)), 1, 8))::bigint % {LEARN} = 0 as learns from labels where doc_id is not null group by doc_id having min(quality) = 1),
held as (select fails.*, learns from fails join good using (doc_id)),
strata as (select lang, count(distinct doc_id) filter (learns) as n, count(distinct doc_id) filter (not learns) as m from held group by lang having count(distinct doc_id) filter (not learns) >= ceil(ln({delta}) / ln(1 - {risk}))),
beyond as (select s.lang, grid.rule, grid.i, s.n, (select count(*) from held where held.lang is not distinct from s.lang and held.rule = grid.rule and learns and f > grid.i) as k from strata s, grid),
proposed as (select s.lang, sizes.rule, coalesce((select min(i) from beyond b where b.lang is not distinct from s.lang and b.rule = sizes.rule and k <= {risk / (2 * len(GRIDS))} * b.n), sizes.n) as p from strata s, sizes),
step as (select held.doc_id, held.lang, max(f - p) as step from held join proposed p on p.lang is not distinct from held.lang and p.rule = held.rule where not learns group by all),
tests as (select s.lang, st.s, s.m, (select count(*) from step where step.lang is not distinct from s.lang and step.step > st.s) as k from strata s, range(0, {STEPS + 1}) st(s)),
broken as (select lang, coalesce(max(s) filter (k >= m * {risk} or {tail} > {delta} / (select count(*) from strata)), -1) + 1 as s from tests group by lang),
sure as (select p.lang, p.rule, p.p + b.s as i from proposed p join broken b on b.lang is not distinct from p.lang where b.s <= {STEPS}),
failed as (select fails.doc_id, string_agg(fails.rule, ',' order by fails.rule) as rules from fails join sure on sure.rule = fails.rule and sure.lang is not distinct from fails.lang join sizes on sizes.rule = fails.rule and sure.i < sizes.n where f > sure.i group by fails.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, coalesce(rules, '') as failed_rules,
exists (select 1 from sure where sure.lang is not distinct from c.lang) as certified, not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and rules is null as kept from c left join failed using (doc_id)"""


def near_dups(k: int = 4, percent: int = 80) -> str:
    return f"""with recursive d as (select doc_id, coalesce(regexp_extract_all({_LOWER}, '{WORD}'), []) as w from documents),
s as (select distinct doc_id, unnest(list_transform(range(1, greatest(len(w) - {k - 1}, 1) + 1), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) as g from d where len(w) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
both_ as (select x.doc_id as a, y.doc_id as b, count(*) as i from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by all),
e as (select a, b from both_ join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= {percent} * (x.n + y.n - i)),
reach as (select doc_id, doc_id as m from d union select e.b, reach.m from reach join e on e.a = reach.doc_id),
c as (select doc_id, min(m) as component_id from reach group by doc_id)
select c.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, c.doc_id = component_id as kept from c left join n using (doc_id)"""


def line_dedup(least: int = 20) -> str:
    one = "case when length(x) = length(y) then len(list_filter(range(1, length(x) + 1), lambda i: x[i] <> y[i])) <= 1 else len(list_filter(range(1, length(x) + 1), lambda i: x[1:i - 1] = y[1:i - 1] and x[i + 1:] = y[i:])) > 0 end"
    return f"""with ln as (select doc_id, unnest(l) as line, unnest(range(1, len(l) + 1)) as pos from (select doc_id, string_split(text, chr(10)) as l from documents where text is not null)),
f as (select line, min(doc_id) as first from ln where regexp_matches(line, '{WORD}') group by line),
keyed as (select line, first, n, side, case when side = 1 then left(line, n // 2) else right(line, n - n // 2) end as part from (select *, unnest([length(line), length(line) - 1]) as n from f where length(line) >= {least}), (values (1), (2)) t(side)),
near as (select distinct case when (x.first, x.line) < (y.first, y.line) then y.line else x.line end as line from keyed x join keyed y on x.n = y.n and x.side = y.side and x.part = y.part and x.line <> y.line and length(x.line) >= length(y.line) and length(y.line) = y.n
  where (select {one} from (select x.line as x, y.line as y))),
judged as (select ln.*, f.first, near.line is not null as near, first is not null and (near.line is not null or first < doc_id or row_number() over (partition by doc_id, ln.line order by pos) > 1) as gone
  from ln left join f using (line) left join near using (line)),
d as (select doc_id, count(*) as n_lines, count(*) filter (gone) as n_removed, count(distinct line) filter (near and first = doc_id and length(line) >= {least}) as n_near, string_agg(line, chr(10) order by pos) filter (not gone) as kept from judged group by doc_id)
select documents.doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_near, 0)::bigint as n_near, case when text is not null then sha256(coalesce(kept, '')) end as kept_sha256 from documents left join d using (doc_id)"""


ORACLES: dict[str, str] = {
    "op2_decontaminate": decontamination(),
    "op5_mix_sources": mixing(),
    "op7_quality_rules": quality(),
    "op8_minhash_near_dups": near_dups(),
    "op10_line_dedup": line_dedup(),
}
