"""DuckDB SQL for the rows of operators that SQL can express over whole tables."""

from __future__ import annotations

import math

from . import quality

#: Operator 7: links by counting shared n-grams, then everything that is reachable.
JACCARD = r"""
with recursive w as (
  select doc_id, [x for x in string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] as words from documents
), s as (
  select doc_id, case when len(words) = 0 then [] when len(words) < 5 then [array_to_string(words, ' ')]
    else list_distinct([array_to_string(words[i : i + 4], ' ') for i in range(1, len(words) - 3)]) end as shingles from w
), sized as (select doc_id, len(shingles) as n from s),
one as (select doc_id, unnest(shingles) as shingle from s),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from one a join one b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from common join sized x on x.doc_id = a join sized y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
edge as (select a, b from links union all select b, a from links),
reach(a, b) as (select a, b from edge union select r.a, e.b from reach r join edge e on r.b = e.a),
low as (select a, min(b) as b from reach group by a)
select s.doc_id, s.n::bigint as n_shingles, least(s.doc_id, coalesce(low.b, s.doc_id)) as component_id from sized s left join low on low.a = s.doc_id
"""

#: Operator 10: links by all pairs, then everything that is reachable.
EMBEDDINGS = """
with recursive v as (select vec_id, embedding::double[] as e from embeddings),
ok as (select vec_id, e, sqrt(list_dot_product(e, e)) as norm from v where e is not null and len(e) > 0 and len([x for x in e if x is null or not isfinite(x)]) = 0 and len([x for x in e if x <> 0]) > 0),
edge as (select a.vec_id as a, b.vec_id as b from ok a join ok b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
reach(a, b) as (select a, b from edge union select r.a, e.b from reach r join edge e on r.b = e.a),
found as (select a, min(b) as low from reach group by a), counted as (select a, count(*) as n from edge group by a)
select vec_id, coalesce(c.n, 0)::bigint as n_links, least(vec_id, coalesce(f.low, vec_id)) as component_id, vec_id = least(vec_id, coalesce(f.low, vec_id)) as kept
from v left join found f on f.a = vec_id left join counted c on c.a = vec_id
"""


def quality_sql() -> str:
    """Counts, sketches, fences and verdicts of operator 5."""
    m = quality.FACTORS

    def level(name: str, keys: list[str]) -> str:
        """Quantiles and fences of the sketches by ``keys``."""
        by = "".join(f"{k}, " for k in keys)
        wide = []
        for k, (up, floor, down) in m.items():
            q = lambda n, k=k: f"max(q{n}) filter (where metric = '{k}')"
            wide.append(f"greatest({q(75)} + ({q(75)} - {q(25)}) * {quality.FENCE}::double, {q(90)} * {up}::double, {floor}::double) as {k}_most")
            if down is not None:
                wide.append(f"least({q(25)} - ({q(75)} - {q(25)}) * {quality.FENCE}::double, {q(10)} * {down}::double) as {k}_least")
        at = ", ".join(f"min(case when upto * 100 >= {n} * total then value end) as q{n}" for n in (10, 25, 75, 90))
        return f"""{name}_sketch as (select {by}metric, bucket, count(*) as n from placed group by all),
{name}_ranked as (select *, sum(n) over (partition by {by}metric order by bucket rows unbounded preceding) as upto, sum(n) over (partition by {by}metric) as total, case when bucket > {quality.ZERO} then pow({quality.GAMMA}::double, bucket - 0.5::double) else 0.0::double end as value from {name}_sketch),
{name}_q as (select {by}metric, any_value(total)::double as total, {at} from {name}_ranked group by {by}metric),
{name}_f as (select {by}max(total) as total, {', '.join(wide)} from {name}_q {'group by ' + by.rstrip(', ') if keys else ''})"""
    p = quality.PRIOR
    blend = ", ".join(f"(o.total * o.{c} + {p} * ((l.total * l.{c} + {p} * a.{c}) / (l.total + {p}))) / (o.total + {p}) as {c}" for c in quality.LIMITS)
    fine = " and ".join(f"{k} <= {k}_most" + (f" and {k} >= {k}_least" if v[2] else "") for k, v in m.items())
    return rf"""
with t as (select doc_id, lang, source, coalesce(text, '') as text from documents),
w as (select *, [x for x in string_split_regex(text, '[\x20\x09-\x0D]+') if x <> ''] as words, [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] as lines from t),
windows as (select doc_id, unnest([words[i : i + 2] for i in range(1, len(words) - 1)]) as k, unnest(range(1, len(words) - 1)) as i from w),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, k) as n from windows) where n > 1),
covered as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from twice) group by 1),
c as (
  select w.doc_id, lang, source, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(v.n, 0)::bigint as n_repeat_words, len(lines) as n_lines from w left join covered v on v.doc_id = w.doc_id
), s as (
  select *, (n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > {quality.MAX_REPEAT} * n_words) as base_failed, coalesce(word_chars / nullif(n_words, 0), 0) as word_length, coalesce(n_symbols / nullif(word_chars, 0), 0) as symbol_ratio,
    coalesce(n_dup_lines / nullif(n_lines, 0), 0) as dup_line_ratio, coalesce(n_repeat_words / nullif(n_words, 0), 0) as repeat_ratio from c
), measured as (
  select lang, source, unnest(['word_length', 'symbol_ratio', 'dup_line_ratio', 'repeat_ratio']) as metric, unnest([word_length, symbol_ratio, dup_line_ratio, repeat_ratio]) as x from s where not base_failed
), placed as (select lang, source, metric, case when x > 0 then greatest({quality.ZERO}, ceil(ln(x) / {math.log(quality.GAMMA)!r}::double))::int else {quality.ZERO} end as bucket from measured),
{level('own', ['lang', 'source'])},
{level('by_lang', ['lang'])},
{level('overall', [])},
fences as (select o.lang, o.source, {blend} from own_f o join by_lang_f l on o.lang is not distinct from l.lang cross join overall_f a)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (not base_failed and coalesce({fine}, true)) as kept
from s left join fences f on s.lang is not distinct from f.lang and s.source is not distinct from f.source
"""
