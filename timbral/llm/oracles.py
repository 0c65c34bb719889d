r"""SQL for the rows of the operators that SQL can express: op1, op4, op9, op10, op11 and op12.

op2 needs XXH64, op5 and op6 are fitted, op7 and op13 merge a vocabulary's pairs, and op3 and op8 add what
an automaton or a fitted field finds; tests/llm holds these against brute force.
"""

from __future__ import annotations

from timbral.llm import chat, fim, rules

WORD = r"[^\x20\x09-\x0D]+"
LOW_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _escaped(c: str) -> str:
    for plain, code in chat.ESCAPES:
        c = f"replace({c}, {_quote(plain)}, {_quote(code)})"
    return c


def op1() -> str:
    marks = " ".join(f"when {_quote(r)} then {len(chat.OPEN[r]) + len(chat.CLOSE[r])}" for r in chat.OPEN)
    other = len(chat.OTHER_OPEN) + len(chat.OTHER_MID) + len(chat.OTHER_CLOSE)
    b, h, ht, least = chat.BUDGET, chat.HISTORY, chat.HISTORY_TOKENS, chat.LEAST_NEW
    return f"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), sized as (
  select *, length({_escaped("text")}) as body, case role {marks} else {other} + length({_escaped("role")}) end as marks from rows
), lined as (
  select *, (body + {chat.CHARS_A_TOKEN - 1}) // {chat.CHARS_A_TOKEN} + {chat.TURN_TOKENS} as tokens,
    row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as place from sized
), summed as (
  select *, sum(tokens) over (partition by conv_id order by place)::bigint as stop,
    coalesce(first_value(case when role = 'system' then tokens end) over (partition by conv_id order by place), 0) as system_tokens from lined
), roomy as (select *, greatest({b} - system_tokens, {least}) as room, greatest(stop - tokens - system_tokens, 0) as pos, greatest(stop - system_tokens, 1) as pos_stop from summed
), celled as (select *, stop - tokens as start, 2 * (pos // room) + case when pos // room = (pos_stop - 1) // room then 0 else 1 end as cell from roomy
), firsts as (
  select *, coalesce(lag(cell) over (partition by conv_id order by place) <> cell, true) as is_first from celled
), numbered as (select *, sum(is_first::int) over (partition by conv_id order by place) as win from firsts
), windows as (select conv_id, min(place) as at, min(start) as at_start, least({ht}, {b} - max(system_tokens) - sum(tokens)) as most from numbered group by conv_id, win
), context as (
  select distinct w.conv_id, w.at, f.place, f.body + f.marks as chars from windows w join firsts f on f.conv_id is not distinct from w.conv_id and f.place < w.at
  where (f.place >= w.at - {h} and w.at_start - f.start <= w.most) or (f.place = 0 and f.role = 'system')
), extra as (select conv_id, sum(chars) as chars from context group by conv_id
), whole as (
  select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by place)) as turns_sha256,
    sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
    sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by place), '')) as loss_sha256,
    sum(body + marks)::bigint as chars, sum(is_first::int)::bigint as n_windows from firsts group by conv_id
)
select w.conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, (w.chars + coalesce(e.chars, 0))::bigint as formatted_chars, n_windows
from whole w left join extra e on e.conv_id is not distinct from w.conv_id"""


OP4 = f"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') as w from documents),
starts as (select r, unnest(range(1, len(w) - 33)) as i from d where len(w) >= 35),
windows as (select starts.r, i, hash(array_to_string(w[i:i + 34], ' ')) as h, array_to_string(w[i:i + 34], ' ') as k from starts join d using (r)),
twice as (select k from windows group by k having count(*) > 1),
gone as (select distinct r, unnest(range(i, i + 35)) as p from windows join twice using (k)),
kept as (
  select d.r, string_agg(x.word, ' ' order by x.p) as text from d, (select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d) x
  left join gone g on g.r = x.r and g.p = x.p where x.r = d.r and g.p is null group by d.r
),
lost as (select r, count(*) as n from gone group by r)
select doc_id, len(w)::bigint as n_words, coalesce(lost.n, 0)::bigint as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from d left join kept using (r) left join lost using (r)"""


def op9() -> str:
    shares = {
        "repeat_share": "1000 * n_repeat_words // greatest(n_words, 1)", "dup_line_share": "1000 * n_dup_lines // greatest(n_lines, 1)",
        "mean_word": "100 * word_chars // greatest(n_words, 1)", "plain_word": "100 * (word_chars - n_symbols) // greatest(n_words, 1)",
    }
    shift = f"greatest(length(bin(v)) - {rules.BITS}, 0)"
    values = " union all ".join(f"select lang, source, '{m}' as measure, {m} as v from fed" for m in rules.MEASURES)
    least = ", ".join(f"min(case when upto * 100 >= total * {q} then bucket end) as q{q}" for q in rules.QUANTILES)
    drawn = ", ".join(f"(o.n * o.q{q} + {rules.PRIOR} * w.q{q}) // (o.n + {rules.PRIOR}) as q{q}" for q in rules.QUANTILES)
    fences = ", ".join(
        [f"max(case when measure = '{m}' then {what} end) as {name}_{m}" for m in rules.WORDS for name, what in (("low", "q25"), ("high", "q75"), ("spread", "greatest(q75 - q25, l75 - l25)"))]
        + [f"max(case when measure = '{m}' then q99 + {rules.SPREAD} * (q99 - q90) end) as most_{m}" for m in rules.SHARES]
    )
    return f"""
with d as (select row_number() over () as r, doc_id, lang, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{WORD}') as w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) as lines from documents),
fives as (select r, i, array_to_string(w[i:i + 4], ' ') as k from (select r, w, unnest(range(1, len(w) - 3)) as i from d where len(w) >= 5)),
twice as (select r, k from fives group by r, k having count(*) > 1),
rep as (select r, count(distinct p) as n from (select r, unnest(range(i, i + 5)) as p from fives join twice using (r, k)) group by r),
m as (select d.r, doc_id, lang, source, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
  len(lines)::bigint as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words from d left join rep using (r)),
s as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, {", ".join(f"{v} as {k}" for k, v in shares.items())} from m),
fed as (select * from s where not base_failed),
vals as ({values}),
sketch as (select lang, source, measure, ((v >> {shift}) << {shift}) as bucket, count(*) as n from vals group by all),
cum as (select *, sum(n) over (partition by lang, source, measure order by bucket) as upto, sum(n) over (partition by lang, source, measure) as total from sketch),
own as (select lang, source, measure, max(total)::bigint as n, {least} from cum group by all),
lsketch as (select lang, measure, bucket, sum(n) as n from sketch group by all),
lcum as (select *, sum(n) over (partition by lang, measure order by bucket) as upto, sum(n) over (partition by lang, measure) as total from lsketch),
wide as (select lang, measure, {least} from lcum group by all),
drawn as (select o.lang, o.source, o.measure, w.q25 as l25, w.q75 as l75, {drawn} from own o join wide w on o.lang is not distinct from w.lang and o.measure = w.measure),
fences as (select lang, source, max(case when measure = 'n_words' then q50 end) as median_words, {fences} from drawn group by all)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce({rules.WITHIN}, true) as kept, s.lang, s.source
from s left join fences f on s.lang is not distinct from f.lang and s.source is not distinct from f.source"""


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP10 = f"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all({_LOW}, '{LOW_WORD}') as w from documents),
b as (select item_id, regexp_extract_all({_LOW}, '{LOW_WORD}') as w from benchmark),
iw as (select distinct item_id, least(len(w), 10) as n, array_to_string(w[i:i + 9], ' ') as k from (select *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
sizes as (select distinct n from iw),
dw as (select r, i, n, array_to_string(w[i:i + n - 1], ' ') as k from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
hits as (select r, i, dw.n, item_id from dw join iw on dw.k = iw.k and dw.n = iw.n),
words as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from hits) group by r),
items as (select r, count(*) as n_items, string_agg(x, ',' order by x) as s from (select distinct r, item_id::varchar as x from hits where item_id is not null) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (r) left join items using (r)"""


OP11 = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256 from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by text_sha256) as group_size, row_number() over w = 1 as kept, text_sha256
from d window w as (partition by text_sha256 order by length(t) desc, doc_id nulls last, r)"""


def op12() -> str:
    p, s, m = fim.PREFIX, fim.SUFFIX, fim.MIDDLE
    return rf"""
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{fim.LINES}') as u, sha256('{fim.SEED}:' || coalesce(doc_id::varchar, '')) as h from documents),
h as (select *, len(u) as n, {", ".join(f"('0x' || h[{8 * i + 1}:{8 * i + 8}])::bigint as h{i + 1}" for i in range(4))} from d),
r as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
  case when t = '' or contains(t, '{p}') or contains(t, '{s}') or contains(t, '{m}') or h3 % 100 >= {fim.RATE} then 'plain' when h4 % 100 < {fim.SPM} then 'spm' else 'psm' end as form from h),
x as (select *, coalesce(array_to_string(u[1:a], ''), '') as pre, coalesce(array_to_string(u[a + 1:b], ''), '') as mid, coalesce(array_to_string(u[b + 1:], ''), '') as suf from r)
select doc_id, n, form, case when form <> 'plain' then length(pre) end as prefix_chars, case when form <> 'plain' then length(mid) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '{p}' || pre || '{s}' || suf || '{m}' || mid else '{s}' || suf || '{p}' || pre || '{m}' || mid end) as output_sha256, sha256(t) as restored_sha256 from x"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": op1(), "op4_substring_dedup": OP4, "op9_quality_rules": op9(), "op10_decontaminate": OP10, "op11_exact_dedup": OP11, "op12_fill_in_middle": op12()}
