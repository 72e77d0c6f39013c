"""DuckDB's SQL for what the span operators find and decide, written from their definitions."""

from __future__ import annotations

from inkveil.functions.rules import AREAS, PRIORITIES
from inkveil.functions.validators import REASONS
from inkveil.plans.seed import corpus_sql

AS_OF = "date '2026-01-01'"
# The rules for an engine without lookaround; those with digit guards as (body, characters at most).
PLAIN = {
    "card": r"(?:[0-9][ -]?){15,16}",
    "email": r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "phone_mobile": r"01[016789]-?[0-9]{3,4}-?[0-9]{4}",
    "phone_city": r"(?:02|0(?:3[1-3]|4[1-4]|5[1-5]|6[1-4]))-?[0-9]{3,4}-?[0-9]{4}",
    "passport": r"(?:[MSRODG][0-9]{8}|[MSRODG][0-9]{3}[A-Z][0-9]{4})",
}
GUARDED = {
    "rrn": (r"[0-9]{6}[-\s]?[0-490][0-9]{6}", 14),
    "fgn": (r"[0-9]{6}[-\s]?[5-8][0-9]{6}", 14),
    "driver_license": (rf"(?:{AREAS})-?[0-9]{{2}}-?[0-9]{{6}}-?[0-9]{{2}}", 15),
}


def found(rule: str, table: str = "seed", key: str = "doc_id", text: str = "text", sensitive: bool = False) -> str:
    """Rows (key, rule, s, e, value) of a rule's matches."""
    flag = "" if sensitive else "(?i)"
    if rule in PLAIN:
        rx = f"'{flag}{PLAIN[rule]}'"
        return f"""select {key}, '{rule}' as rule, s, s + length(value) as e, value from (
            select {key}, v[i] as value, cast(list_sum([length(x) for x in g[1:i]]) + coalesce(list_sum([length(x) for x in v[1:i-1]]), 0) as int) as s
            from (select {key}, v, g, unnest(range(1, len(v) + 1)) as i from (select {key}, regexp_extract_all({text}, {rx}) as v, string_split_regex({text}, {rx}) as g from {table} where {text} is not null)))"""
    body, n = GUARDED[rule]
    return f"""select {key}, '{rule}' as rule, s, s + length(value) as e, value from (
        select {key}, cast(i - 1 as int) as s, regexp_extract(substr({text}, i, {n + 1}), '^({body})(?:[^0-9]|$)', 1) as value
        from (select {key}, {text}, unnest(range(1, length({text}) + 1)) as i from {table} where regexp_matches({text}, '[0-9]{{6}}'))
        where (i = 1 or not regexp_matches(substr({text}, i - 1, 1), '[0-9]')) and regexp_matches(substr({text}, i, 2), '[0-9][0-9]')) where value <> ''"""


def digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '', 'g')"


def born(d: str) -> str:
    """The date of the first six digits, or null."""
    return f"try_strptime(concat(case when cast(substr({d}, 1, 2) as int) <= 68 then '20' else '19' end, substr({d}, 1, 6)), '%Y%m%d')::date"


def check(d: str) -> str:
    terms = " + ".join(f"{w} * cast(substr({d}, {i}, 1) as int)" for i, w in enumerate([2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5], 1))
    return f"((11 - ({terms}) % 11) % 10)"


def luhn(d: str) -> str:
    """Whether the digits pass, by positions from the right."""
    return f"(list_sum([case when (length({d}) - p) % 2 = 1 then (cast(substr({d}, p, 1) as int) * 2) // 10 + (cast(substr({d}, p, 1) as int) * 2) % 10 else cast(substr({d}, p, 1) as int) end for p in range(1, length({d}) + 1)]) % 10 = 0)"


def hyphens(v: str) -> str:
    return f"(length({v}) - length(replace({v}, '-', '')))"


def year2(y: str) -> str:
    return f"(case when {y} > 26 then 1900 + {y} else 2000 + {y} end)"


def valid(rule: str = "rule", v: str = "value") -> str:
    d = digits(v)
    yy = f"cast(substr({d}, 1, 2) as int)"
    seven = f"substr({d}, 7, 1)"
    year = f"(case when {seven} in ('1', '2') then 1900 + {yy} when {seven} in ('3', '4') then 2000 + {yy} when {seven} in ('0', '9') then 1800 + {yy} else {year2(yy)} end)"
    return f"""coalesce(case {rule}
        when 'rrn' then length({d}) = 13 and {born(d)} <= {AS_OF} and ({year} >= 2020 or {check(d)} = cast(substr({d}, 13, 1) as int))
        when 'fgn' then length({d}) = 13 and {born(d)} <= {AS_OF} and ({year2(yy)} >= 2020 or ({check(d)} + 2) % 10 = cast(substr({d}, 13, 1) as int))
        when 'phone_mobile' then substr({d}, 1, 3) = '010' and length({d}) = 11 and ({hyphens(v)} = 0 or regexp_full_match({v}, '010-[0-9]{{3,4}}-[0-9]{{4}}'))
        when 'phone_city' then case when {hyphens(v)} = 2 then regexp_full_match({v}, '0[0-9]{{1,2}}-[0-9]{{3,4}}-[0-9]{{4}}')
            when {hyphens(v)} = 0 then case when substr({d}, 1, 2) = '02' then length({d}) in (9, 10) else length({d}) in (10, 11) end else false end
        when 'card' then length({d}) in (15, 16) and {luhn(d)} and case when length({d}) = 16 then substr({d}, 1, 1) in ('4', '6', '9') or substr({d}, 1, 2) between '51' and '55'
            or substr({d}, 1, 4) between '2221' and '2720' or substr({d}, 1, 2) = '35' else substr({d}, 1, 2) in ('34', '37') end
        when 'driver_license' then length({d}) = 12 and substr({d}, 1, 2) between '11' and '26' and {year2(f"cast(substr({d}, 3, 2) as int)")} between 1995 and 2026
        else true end, false)"""


def reason(rule: str = "rule", v: str = "value") -> str:
    d = digits(v)
    n = f"length({d})"

    def text(name: str, value: str = "") -> str:
        own = REASONS[name]
        return f"'{own}'" if isinstance(own, str) else f"concat('{own[0]}', cast({value} as varchar), '{own[1]}')"

    return f"""case {rule}
        when 'rrn' then case when {n} <> 13 then {text('length13', n)} when {born(d)} is null then {text('date')} when {born(d)} > {AS_OF} then {text('future')}
            when {check(d)} <> cast(substr({d}, 13, 1) as int) then {text('checksum')} else {text('failed')} end
        when 'fgn' then case when {n} <> 13 then {text('length13', n)} when {born(d)} is null then {text('date')}
            when ({check(d)} + 2) % 10 <> cast(substr({d}, 13, 1) as int) then {text('checksum')} else {text('failed')} end
        when 'phone_mobile' then case when {hyphens(v)} not in (0, 2) then {text('hyphens', hyphens(v))} when substr({d}, 1, 3) <> '010' then {text('not010')} when {n} <> 11 then {text('length11', n)} else {text('phone')} end
        when 'phone_city' then case when {hyphens(v)} not in (0, 2) then {text('hyphens', hyphens(v))} when substr({d}, 1, 2) = '02' then case when {n} not in (9, 10) then {text('seoul', n)} else {text('phone')} end
            when {n} not in (10, 11) then {text('area', n)} else {text('phone')} end
        when 'card' then case when {n} not in (15, 16) then {text('length15', n)} when not {luhn(d)} then {text('luhn')} when {n} = 16 and substr({d}, 1, 1) not in ('2', '4', '5', '6', '8', '9') then {text('issuer', f"substr({d}, 1, 1)")} else {text('card')} end
        when 'driver_license' then case when {n} <> 12 then {text('length12', n)} when substr({d}, 1, 2) not between '11' and '26' then {text('region', f"substr({d}, 1, 2)")} else {text('driver')} end
        else null end"""


PRIORITY = "case rule " + " ".join(f"when '{name}' then {p}" for name, p in PRIORITIES.items()) + " end"


def matches(table: str = "seed", key: str = "doc_id", text: str = "text", rules: list[str] | None = None) -> str:
    """Expressions ``cand`` (all candidates, with valid and reason) and ``kept`` (after the overlap filter)."""
    every = " union all ".join(found(r, table, key, text) for r in (rules or [*PLAIN, *GUARDED]))
    return f"""raw as materialized ({every}),
    cand as materialized (select r.{key}, rule, s, e, value, {PRIORITY} as prio, {valid()} as valid, case when not {valid()} then {reason()} end as reason,
        substr(t.{text}, greatest(s - 20, 0) + 1, least(e + 20, length(t.{text})) - greatest(s - 20, 0)) as context from raw r join {table} t on r.{key} = t.{key}),
    kept as materialized (select * from cand m where valid or (not exists (select 1 from cand v where v.{key} = m.{key} and v.valid and v.s < m.e and m.s < v.e)
        and (rule in ('rrn', 'fgn') or not exists (select 1 from cand h where h.{key} = m.{key} and h.rule in ('rrn', 'fgn') and h.s < m.e and m.s < h.e))))"""


def seeded(select: str, found_too: bool = True) -> str:
    """A query over the seeded corpus, and its matches."""
    return f"with {corpus_sql()}{', ' + matches() if found_too else ''}\n{select}"
