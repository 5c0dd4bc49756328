"""The operators that SQL can express, in DuckDB's SQL. Constants come from the operators."""

from __future__ import annotations

from . import chat, licenses, quality_rules
from .quality_rules import MIN_GROUP, MIN_WORDS, REACH, SPREAD


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def fenced() -> str:
    """op3: measures, sketches, fences and verdicts."""
    ratio = {"mean_length": ("word_chars", "n_words"), "symbols": ("n_symbols", "n_words"), "repeats": ("n_repeat_words", "n_words"), "dup_lines": ("n_dup_lines", "n_lines")}
    value = {m: f"((1000 * {a}) // greatest({b}, 1))" for m, (a, b) in ratio.items()}
    pairs = " union all ".join(f"select lang, source, {quoted(m)} measure, {v} v from m where not base_failed" for m, v in value.items())
    levels = {"own": ["lang", "source"], "of_lang": ["lang"], "of_all": []}
    parts = []
    for name, keys in levels.items():
        by = ", ".join([*keys, "measure"])
        parts.append(f"""{name} as (select {by}, min(case when upto * 4 >= total then bucket end) q1, min(case when upto * 4 >= total * 3 then bucket end) q3, max(total) total from
          (select *, sum(n) over (partition by {by} order by bucket) upto, sum(n) over (partition by {by}) total from (select {by}, bucket, sum(n) n from sketch group by {by}, bucket)) group by {by})""")
    pick = lambda c: f"case when a.total >= {MIN_GROUP} then a.{c} when b.total >= {MIN_GROUP} then b.{c} else c.{c} end"
    least = "case a.measure " + " ".join(f"when {quoted(m)} then {v}" for m, v in SPREAD.items()) + " end"
    high = " and ".join(f"{v} <= high_{m}" for m, v in value.items())
    return f"""with d as (select row_number() over () rid, doc_id, lang, source, coalesce(text, '') t from documents),
     w as (select *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) ls from d),
     g as (select rid, ws, unnest(range(1, len(ws) - 1)) i from w where len(ws) > 3),
     twice as (select rid, i from (select rid, i, count(*) over (partition by rid, ws[i], ws[i + 1], ws[i + 2]) c from g) where c > 1),
     covered as (select rid, count(distinct p) n from (select rid, unnest([i, i + 1, i + 2]) p from twice) group by rid),
     m as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words base_failed from (select doc_id, lang, source, len(ws)::bigint n_words, length(array_to_string(ws, ''))::bigint word_chars,
       (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint n_symbols, len(ls)::bigint n_lines, (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines, coalesce(n, 0)::bigint n_repeat_words from w left join covered c on w.rid = c.rid)),
     v as ({pairs}),
     sketch as (select lang, source, measure, (v >> greatest(length(bin(v)) - 10, 0)) << greatest(length(bin(v)) - 10, 0) bucket, count(*) n from v group by all),
     {", ".join(parts)},
     fit as (select a.lang, a.source, a.measure, {pick("q1")} q1, {pick("q3")} q3, {least} least from own a join of_lang b on a.measure = b.measure and a.lang is not distinct from b.lang join of_all c on a.measure = c.measure),
     fences as (select lang, source, {", ".join(f"max(case when measure = {quoted(m)} then q3 + {REACH} * greatest(q3 - q1, least) end) high_{m}" for m in SPREAD)},
       max(case when measure = 'mean_length' then q1 - {REACH} * greatest(q3 - q1, least) end) low from fit group by lang, source)
     select doc_id, {", ".join(quality_rules.MEASURES)}, not base_failed and coalesce({high} and {value["mean_length"]} >= low, true) kept
     from m left join fences f on m.lang is not distinct from f.lang and m.source is not distinct from f.source"""


def conversed() -> str:
    """op5: digests straight from the rows, and the length that the template gives."""
    escaped = lambda c: f"(2 * length({c}) - length(translate({c}, '\\#<', '')))"
    block = len(chat.OPEN) + 2 + len(chat.END) + 1
    return f"""with c as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') x from conversations union all select -7, 0, 'user', {quoted(chat.SAMPLE)} union all select -7, 1, 'assistant', {quoted(chat.SAMPLE)}),
     o as (select *, lag(r) over (partition by conv_id order by turn, r, x) was from c),
     s as (select conv_id, count(*) n_turns, string_agg(r || chr(10) || x || chr(10), '' order by turn, r, x) lines, coalesce(string_agg(case when r = {quoted(chat.LOSS_ROLE)} then x end, '' order by turn, r, x), '') loss,
       sum({escaped("x")}) + sum(case when was is distinct from r then {block} + {escaped("r")} else {len(chat.END)} end) formatted from o group by conv_id)
     select conv_id, n_turns, sha256(lines) turns_sha256, length(loss)::bigint loss_chars, sha256(loss) loss_sha256, formatted::bigint formatted_chars from s"""


def canonical(line: str) -> str:
    out = f"case when regexp_matches(lower({line}), {quoted(licenses.COPYRIGHT)}) then '' else lower({line}) end"
    for spelling, one in licenses.SPELLINGS.items():
        out = f"replace({out}, {quoted(spelling)}, {quoted(one)})"
    return f"trim(regexp_replace(translate({out}, {quoted(licenses.PUNCTUATION)}, ''), '\\s+', ' ', 'g'))"


def licensed() -> str:
    """op7: digests of lines and whole texts, joined with those of the known texts."""
    texts = [(k, v) for k, v in licenses.KNOWN.items()] + [(k, v) for k, vs in licenses.NOTICES.items() for v in vs]
    rows = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in texts)
    lines = f"list_filter(list_transform(regexp_split_to_array(t, '\\r?\\n'), lambda l: {canonical('l')}), lambda x: x <> '')"
    permissive = ", ".join(map(quoted, licenses.PERMISSIVE))
    return f"""with known as (select distinct license, sha256(array_to_string({lines}, ' ')) digest from (values {rows}) k(license, t)),
     d as (select row_number() over () rid, doc_id, coalesce(text, '') t from documents), l as (select rid, doc_id, {lines} ls from d),
     u as (select rid, true whole, sha256(array_to_string(ls, ' ')) digest from l union all select rid, false, sha256(x) from (select rid, unnest(ls) x from l)),
     f as (select rid, max(case when whole then license end) license, list_sort(list(distinct license)) licenses, count(*) filter (not whole) n_notices from u join known using (digest) group by rid)
     select doc_id, license, coalesce(licenses, []::varchar[]) licenses, coalesce(n_notices, 0)::bigint n_notices, case when licenses is not null then len(list_filter(licenses, lambda x: x not in ({permissive}))) = 0 end permissive from d left join f using (rid)"""


def oracle_sql() -> dict[str, str]:
    return {"op3_adaptive_quality": fenced(), "op5_relational_chat": conversed(), "op7_license_digest": licensed()}
