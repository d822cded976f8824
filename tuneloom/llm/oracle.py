"""The same results in SQL for DuckDB, where SQL can express them."""

from __future__ import annotations

from tuneloom.llm.licences import COPYRIGHT_LINE, SPELLINGS, known_texts

OP1 = r"""
with sized as (
  select row_number() over () as nr, doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::bigint as size
  from documents),
sizes as (select source, sum(size)::bigint as source_size from sized group by source),
nth as (select *, row_number() over (order by source asc nulls last) - 1 as n from sizes),
parts as (
  select source, source_size, (n % 3 + 1)::double as weight, 3.0::double * source_size as room, sum(source_size::double) over () as total from nth),
levels as (
  select *, (total - coalesce(sum(room) over before, 0.0::double)) / (sum(weight) over () - coalesce(sum(weight) over before, 0.0::double)) as level
  from parts window before as (order by room / weight, weight rows between unbounded preceding and 1 preceding)),
filled as (select *, level * weight > room as capped, max(case when not (level * weight > room) then level end) over () as open_level from levels),
targets as (
  select source, source_size, case when capped then room else least(room, open_level * weight) end as target from filled),
rates as (
  select *, floor(target / source_size) as whole,
    target / source_size - floor(target / source_size) as part
  from targets where source_size > 0),
drawn as (
  select s.*, r.source_size, r.target, r.whole, r.part,
    (('0x' || substr(md5('7|' || coalesce(doc_id::varchar, 'null') || '|' || size), 1, 13))::bigint::double + 0.5::double) / 4503599627370496.0::double as u
  from sized s left join rates r on s.source is not distinct from r.source),
ratios as (select *, case when part > 0 then (u / (1 - u)) / (part / (1 - part)) end as ratio from drawn),
ordered as (
  select *, sum(size) over (partition by source order by ratio / (1 + ratio), doc_id, size rows unbounded preceding) as up_to
  from ratios where part > 0 and size > 0)
select d.doc_id, d.size, coalesce(t.source_size, 0)::bigint as source_size, coalesce(t.target, 0.0::double) as target,
  (coalesce(d.whole, 0) * d.size + case when o.up_to - o.size / 2 <= d.target - d.whole * d.source_size then d.size else 0 end)::bigint as taken
from drawn d
left join targets t on d.source is not distinct from t.source
left join ordered o on o.nr = d.nr
"""



def _canonical(text: str) -> str:
    text = f"trim(regexp_replace(regexp_replace(lower(coalesce({text}, '')), '{COPYRIGHT_LINE}', '', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    for spelling, common in SPELLINGS:
        text = f"replace({text}, '{spelling}', '{common}')"
    return f"sha256({text})"


def op5() -> str:
    listed = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in known_texts())
    return f"""
with known as (select {_canonical('t')} as digest, min(n) as licence from (values {listed}) as k(n, t) group by 1),
whole as (select doc_id, text, {_canonical('text')} as canonical_sha256 from documents),
lines as (select doc_id, canonical_sha256, unnest(string_split(text, chr(10))) as line from whole),
found as (
  select distinct doc_id, canonical_sha256, k.licence from lines join known k on {_canonical('line')} = k.digest
  where trim(line) <> ''),
notices as (select doc_id, canonical_sha256, string_agg(licence, ',' order by licence) as notices from found group by 1, 2)
select w.doc_id, w.canonical_sha256, k.licence, coalesce(n.notices, '') as notices
from whole w left join known k on k.digest = w.canonical_sha256
left join notices n on n.doc_id is not distinct from w.doc_id and n.canonical_sha256 = w.canonical_sha256
"""


OP6 = r"""
with normal as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as body from documents)
select doc_id, min(doc_id) over (partition by body) as keep_id, count(*) over (partition by body) as group_size,
  row_number() over (partition by body order by doc_id) = 1 as kept, sha256(body) as text_sha256
from normal
"""


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


def op11() -> str:
    """Whole-text expressions instead of a prefilter; where a match starts follows from what lies between matches."""
    words = "|".join(map(_any_case, ("password", "passwd", "secret", "token"))) + "|" + _any_case("api") + "_?" + _any_case("key")
    token = "list_reduce(list_prepend(4294967295::bigint, [ord(c)::bigint for c in string_split(substr({body}, 1, 30), '')]), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))"
    digits = "[strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', c)::bigint - 1 for c in string_split(substr({body}, 31, 6), '')]"
    fits = "length({body}) = 36 and xor(4294967295::bigint, " + token + ") = list_reduce(" + digits + ", lambda v, d: v * 62 + d)"
    kinds = [
        ("assign", rf"""(?:{words})["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", rf"""length(regexp_extract(found, '^(?:{words})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 6"""),
        ("access", "AKIA[A-Z0-9]+", "length(found) >= 20"),
        ("hex", "[0-9a-f]+", "length(found) >= 24"),
        ("github", "gh[pousr]_[0-9A-Za-z]+", fits.format(body="substr(found, 5)")),
        ("npm", "npm_[0-9A-Za-z]+", fits.format(body="substr(found, 5)")),
    ]
    parts = []
    for at, (kind, pattern, holds) in enumerate(kinds):
        quoted = pattern.replace("'", "''")
        parts.append(f"""
          select nr, '{kind}' as kind, {at} as place, found, length(found) as size,
            (list_sum([length(g) for g in gaps[1:i]]) + coalesce(list_sum([length(m) for m in matches[1:i - 1]]), 0))::bigint as begins
          from (select nr, gaps, matches, unnest(matches) as found, unnest(range(1, len(matches) + 1)) as i
            from (select nr, regexp_extract_all(body, '{quoted}') as matches, regexp_split_to_array(body, '{quoted}') as gaps
              from numbered where regexp_matches(body, '{quoted}')))
          where {holds}""")
    return f"""
with numbered as (select row_number() over () as nr, doc_id, coalesce(text, '') as body from documents),
spans as ({" union all ".join(parts)}),
listed as (
  select nr, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
    string_agg(kind || ':' || begins || ':' || (begins + size), ',' order by begins, place) filter (place < 3) as base,
    string_agg(kind || ':' || begins || ':' || (begins + size), ',' order by begins, place) as spans
  from spans group by nr)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from numbered left join listed using (nr)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_pareto_mix": OP1, "op5_licence_digests": op5(), "op6_exact_dedup": OP6, "op11_secret_spans": op11()}
