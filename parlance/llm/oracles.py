"""DuckDB SQL for the rows of those queries that SQL can express."""

from __future__ import annotations

from parlance.llm.licences import CONTAINMENT, PHRASES, TEMPLATES, _tokens, needed
from parlance.llm.quality import STOP_WORDS, THRESHOLDS
from parlance.llm.spelling import LOWER, MIN_CHARS, MIN_COUNT, TIMES, UPPER


def _list(items) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


def _rules() -> str:
    parts = []
    for name, least, most in THRESHOLDS:
        parts += [f"{name} >= {least}"] * (least is not None) + [f"{name} <= {most}"] * (most is not None)
    return " and ".join(parts)


OP3 = f"""
with w as (
  select doc_id, coalesce(text, '') as t,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines
  from documents),
g as (
  select doc_id, i, array_to_string(words[i:i + 4], ' ') as gram
  from (select doc_id, words, unnest(range(1, len(words) - 3)) as i from w)),
again as (select doc_id, gram from g group by 1, 2 having count(*) > 1),
covered as (select g.doc_id, count(distinct p) as n
  from (select g.doc_id, unnest(range(g.i, g.i + 5)) as p from g join again using (doc_id, gram)) g group by 1),
m as (
  select w.doc_id, len(words) as n_words, len(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) as word_chars,
         len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols, len(lines) as n_lines,
         len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words,
         len(list_filter(words, lambda x: list_contains({_list(STOP_WORDS)}, lower(x)))) as n_stop
  from w left join covered c on c.doc_id = w.doc_id),
r as (
  select *, word_chars / greatest(n_words, 1) as mean_word_chars, n_symbols / greatest(n_words, 1) as symbol_ratio,
         (n_stop + 1) / greatest(n_words, 1) as stop_word_ratio, n_dup_lines / greatest(n_lines, 1) as dup_line_ratio,
         (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed
  from m)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
       cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words, base_failed,
       (not base_failed and {_rules()}) as kept
from r
"""

_T = ", ".join(f"({i}, '{label}', {_list(_tokens(t))}, {needed(len(_tokens(t)), CONTAINMENT)})" for i, (label, t) in enumerate(TEMPLATES))
_GAPS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_P = " union all ".join(
    f"select doc_id, i - 1 as pos, '{label}' as label from p where " + " and ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split())) for phrase, label in PHRASES
)
OP6 = f"""
with d as (select doc_id, coalesce(text, '') as t, list_filter(string_split_regex(lower(coalesce(text, '')), '{_GAPS}'), lambda x: x <> '') as w from documents),
p as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d where contains(lower(t), 'license')),
places as ({_P}),
b as (select doc_id, count(*) as n_base, min(pos) as first_word, max(pos) as last_word, list(distinct label) as labels from places group by 1),
lines as (select doc_id, list_distinct(list_filter(string_split_regex(line, '{_GAPS}'), lambda x: x <> '')) as w
  from (select doc_id, unnest(string_split(lower(t), chr(10))) as line from d)),
t(template, label, tokens, least) as (values {_T}),
hit as (select doc_id, label, len(list_intersect(tokens, w)) / len(tokens) as share
  from lines, t where len(w) >= least and len(list_intersect(tokens, w)) >= least),
m as (select doc_id, list(distinct label) as labels, max(share) as best from hit group by 1)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_base, 0) as bigint) as n_base,
       cast(first_word as bigint) as first_word, cast(last_word as bigint) as last_word,
       coalesce(array_to_string(list_sort(b.labels), ','), '') as base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ','), '') as labels,
       case when n_base > 0 then 1.0 else coalesce(best, 0.0) end::double as score
from d left join b on b.doc_id = d.doc_id left join m on m.doc_id = d.doc_id
"""



def _crc_table() -> list[int]:
    """What each byte does to a CRC-32: eight steps by the reversed polynomial."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def _crc32(text: str) -> str:
    """SQL of the unsigned CRC-32 of a string's UTF-8 bytes."""
    octets = f"list_transform(range(1, 2 * octet_length(encode({text})), 2), lambda i: cast('0x' || substr(hex(encode({text})), i, 2) as bigint))"
    fold = f"list_reduce({octets}, lambda c, b: xor(c >> 8, {_crc_table()}[xor(c & 255, b) + 1]::bigint), 4294967295::bigint)"
    return f"xor({fold}, 4294967295::bigint)"


def _framed(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::varchar)) || ':' || {value}::varchar, '-')"


_LEAF = "sha256(" + " || ".join(_framed(x) for x in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
OP11 = f"""
with recursive d as (
  select doc_id, coalesce('=' || source, '') as tree, {_LEAF.format(text="text")} as leaf,
         case when {_crc32("doc_id::varchar")} % 2 = 0 then {_LEAF.format(text="replace(text, chr(10), '')")} end as changed
  from documents),
l as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as rank, count(*) over (partition by tree) as many from d),
nodes(tree, level, i, digest, many) as (
  select tree, 0, rank, leaf, many from l
  union all
  select tree, any_value(level) + 1, i // 3, sha256(string_agg(digest, '' order by i)), (any_value(many) + 2) // 3 from nodes where many > 1 group by tree, i // 3),
tops as (select tree, digest, row_number() over (order by tree) - 1 as k, count(*) over () as many from nodes where many = 1),
upper(level, i, digest, many) as (
  select 0, k, digest, many from tops
  union all
  select any_value(level) + 1, i // 3, sha256(string_agg(digest, '' order by i)), (any_value(many) + 2) // 3 from upper where many > 1 group by i // 3),
steps as (
  select tree, rank, level, coalesce(string_agg(digest, '' order by i) filter (where i < own), '') as before, coalesce(string_agg(digest, '' order by i) filter (where i > own), '') as after
  from (select l.tree, l.rank, x.level, x.i, x.digest, l.rank // cast(pow(3, x.level) as bigint) as own
        from l join nodes x on x.tree = l.tree and x.many > 1 and x.i // 3 = l.rank // cast(pow(3, x.level + 1) as bigint)
        union all
        select l.tree, l.rank, 1000 + x.level, x.i, x.digest, t.k // cast(pow(3, x.level) as bigint)
        from l join tops t on t.tree = l.tree join upper x on x.many > 1 and x.i // 3 = t.k // cast(pow(3, x.level + 1) as bigint))
  group by tree, rank, level),
path as (select *, row_number() over (partition by tree, rank order by level) - 1 as s from steps),
proof as (select tree, rank, sha256(string_agg(before || after, '' order by s)) as proof from path group by tree, rank),
folds(tree, rank, s, node) as (
  select tree, rank, 0, coalesce(changed, leaf) from l
  union all
  select f.tree, f.rank, f.s + 1, sha256(p.before || f.node || p.after) from folds f join path p on p.tree = f.tree and p.rank = f.rank and p.s = f.s),
folded as (select tree, rank, arg_max(node, s) as node from folds group by tree, rank)
select l.doc_id, l.leaf, t.digest as subroot, r.digest as root, coalesce(p.proof, sha256('')) as proof_sha256, f.node as folded_root, f.node = r.digest as verified
from l join tops t on t.tree = l.tree join folded f on f.tree = l.tree and f.rank = l.rank left join proof p on p.tree = l.tree and p.rank = l.rank
cross join (select digest from upper where many = 1) r
"""

OP13 = f"""
with recursive runs as (
  select doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z\\x{{C0}}-\\x{{FF}}]{{{MIN_CHARS},}}')) as run from documents),
hashed as (select run, count, {_crc32("coalesce(doc_id::varchar, '') || ':' || run")} as h from (select doc_id, run, count(*) as count from runs group by all)),
slipped as (select case when h % 199 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, count from hashed),
w as (select word, sum(count)::bigint as n from slipped where length(word) >= {MIN_CHARS} group by word having sum(count) >= {MIN_COUNT}),
skips as (select word, substr(word, 1, i) as head, substr(word, i + 2) as tail from (select word, unnest(range(length(word))) as i from w)),
cuts as (select word, substr(word, 1, i) as head, substr(word, i + 1) as tail from (select word, unnest(range(length(word) + 1)) as i from w)),
near as (
  select a.word as a, b.word as b from skips a join skips b using (head, tail) where a.word <> b.word
  union select a.word, b.word from skips a join cuts b using (head, tail)
  union select b.word, a.word from skips a join cuts b using (head, tail)),
best as (
  select a, count(*) as n_near, arg_min(b, (-n, b)) as b, max(n) as n
  from near join w on w.word = near.b group by a),
m as (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when best.n >= {TIMES} * w.n then best.b end as form, case when best.n >= {TIMES} * w.n then best.n end as form_n
  from w left join best on best.a = w.word),
follow(word, root, s) as (
  select word, word, 0 from m
  union all
  select f.word, m.form, f.s + 1 from follow f join m on m.word = f.root where m.form is not null)
select m.word, m.form, r.root, m.n, m.n_near, m.form_n from m join (select word, arg_max(root, s) as root from follow group by word) r on r.word = m.word
"""

ORACLES = {"op3_quality_rules": OP3, "op6_licence_scan": OP6, "op11_merkle_manifest": OP11, "op13_spelling_variants": OP13}
