"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from .centroids import DIM, K, ROUNDS, SCALE
from .quality_rules import DELTA, RISK, RULES, WINDOW

_NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"

_TESTS = [(r, c) for r, (_, cuts) in RULES.items() for c in cuts]
_VALUES = ", ".join(f"('{r}', {c}::double)" for r, c in _TESTS)
_SCORE = " ".join(f"when '{r}' then {score.replace(' / ', '::double / ')}" for r, (score, _) in RULES.items())
_EPS = RISK / len(RULES)


def _field(c: str) -> str:
    return f"coalesce(octet_length(encode({c}::varchar))::varchar || ':' || {c}::varchar, '-')"


def _row_hash(n_chars: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', n_chars, 'text')))})"


def _crc32(c: str) -> str:
    """Unsigned CRC-32 of an ASCII text, bit by bit."""
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, case when x & 1 = 1 then 3988292384 else 0 end))"
    letters = f"list_transform(string_split({c}, ''), lambda y: ascii(y)::bigint)"
    return f"xor(4294967295, list_reduce(list_concat([4294967295], {letters}), lambda c, b: {bits}))"


def _tree(name: str) -> str:
    """Nodes of every level of ``name`` (grp, pos, n, digest), two of a level to one of the next."""
    return f"""{name}_nodes(grp, level, pos, n, digest) as (
  select grp, 0, pos, n, digest from {name} union all
  select grp, level + 1, pos // 2, any_value(n + 1) // 2, sha256(string_agg(digest, '' order by pos))
  from {name}_nodes where n > 1 group by grp, level, pos // 2),
{name}_path as (
  select t.grp, t.pos, x.level, (t.pos >> x.level) & 1 = 1 as is_right, coalesce(s.digest, '') as sibling
  from {name} t join {name}_nodes x on x.grp = t.grp and x.pos = t.pos >> x.level and x.n > 1
  left join {name}_nodes s on s.grp = t.grp and s.level = x.level and s.pos = xor(t.pos >> x.level, 1))"""


def _centroid_rounds() -> str:
    squares = "list_sum(list_transform(range(1, {0} + 1), lambda i: (v.v[i] - c.v[i]) * (v.v[i] - c.v[i])))::bigint".format(DIM)
    ctes = [f"""v as (select row_number() over () as rn, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v
  from embeddings where len(embedding) = {DIM} and len(list_filter(embedding, lambda x: isfinite(x))) = {DIM}),
c0 as (select row_number() over (order by name, v) - 1 as c, v
  from (select sha256('1:' || coalesce(vec_id::varchar, '')) as name, v from v order by name, v limit {K}))"""]
    for k in range(ROUNDS + 1):
        ctes.append(f"""a{k} as (select rn, min(row(d, c)) as m from (select v.rn, c.c, {squares} as d from v cross join c{k} c) group by rn)""")
        if k < ROUNDS:
            ctes.append(f"""p{k} as (select m[2] as c, i, sum(v.v[i])::hugeint as s, count(*) as n
  from a{k} join v using (rn), range(1, {DIM} + 1) t(i) group by all),
c{k + 1} as (select c.c, coalesce(q.v, c.v) as v from c{k} c
  left join (select c, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as v from p{k} group by c) q using (c))""")
    return ",\n".join(ctes)


SQL = {
    "op1_exact_dedup": f"""
with t as (select doc_id, {_NORM} as norm from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = min(doc_id) over w as kept, sha256(norm) as text_sha256
from t window w as (partition by norm)""",
    "op5_warc_splittable": """
with p as (select page_id, coalesce(html, '') as h, octet_length(encode(coalesce(html, ''))) as n from pages),
f as (select h, max(page_id) as first from p where n >= 1000 group by h having count(*) > 1)
select page_id, n::bigint as payload_bytes, sha1(p.h) as payload_digest,
       case when first is null or first = page_id then 'response' else 'revisit' end as record_type,
       case when first <> page_id then first end as refers_to
from p left join f on p.h = f.h""",
    "op6_quality_rules": rf"""
with t as (select doc_id, coalesce(lang, '') as stratum, coalesce(text, '') as t from documents),
w as (select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from t),
win as (select doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') as g
        from (select doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) as i from w)),
hits as (select doc_id, i from win qualify count(*) over (partition by doc_id, g) > 1),
cov as (select doc_id, sum(least({WINDOW}, coalesce(i - lag_i, {WINDOW}))) as n_repeat_words
        from (select doc_id, i, lag(i) over (partition by doc_id order by i) as lag_i from hits) group by doc_id),
m as (select w.doc_id, stratum, len(ws) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols, len(ls) as n_lines,
             len(ls) - len(list_distinct(ls)) as n_dup_lines,
             coalesce(n_repeat_words, 0)::bigint as n_repeat_words
      from w left join cov using (doc_id)),
tests(rule, cutoff) as (values {_VALUES}),
scored as (select m.*, rule, cutoff, case rule {_SCORE} end as score from m cross join tests),
held as (select * from scored where doc_id in (select doc_id from labels where quality = 1)),
cnt as (select stratum, rule, cutoff, count(*) as n, sum(case when score > cutoff then 1 else 0 end) as k
        from held group by all),
tail as (select *, case when k >= n * {_EPS} then 1.0 else list_sum(list_transform(range(0, k::bigint + 1),
         lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_EPS}) + (n - i) * ln(1 - {_EPS})))) end as p
         from cnt),
cut as (select stratum, rule, min(cutoff) as cutoff from tail
        where p <= {DELTA} / {len(_TESTS)} / (select count(distinct stratum) from held) group by all),
bad as (select distinct doc_id from scored s join cut c
        on s.stratum = c.stratum and s.rule = c.rule and s.score > c.cutoff)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
       not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and doc_id not in (select doc_id from bad) as kept
from m""",
    "op12_merkle_manifest": f"""
with recursive rows as (select doc_id, lang, {_row_hash('n_chars')} as digest,
  case when {_crc32('doc_id::varchar')} % 7 = 0 then {_row_hash('(n_chars::hugeint + 1)')} end as tampered from documents),
leaves as (select *, coalesce('1' || lang, '0') as grp, row_number() over w - 1 as pos, count(*) over (partition by lang) as n
  from rows window w as (partition by lang order by doc_id nulls first, digest)),
{_tree('leaves')},
subs as (select '' as grp, grp as of, digest, row_number() over (order by encode(grp)) - 1 as pos, count(*) over () as n
  from leaves_nodes where n = 1),
{_tree('subs')},
whole as (select l.*, s.digest as subroot, (select digest from subs_nodes where n = 1) as root, s.pos as sub_pos
  from leaves l join subs s on s.of = l.grp),
path as (select w.grp, w.pos, p.level, p.is_right, p.sibling from whole w join leaves_path p on p.grp = w.grp and p.pos = w.pos
  union all select w.grp, w.pos, 1000 + p.level, p.is_right, p.sibling from whole w join subs_path p on p.pos = w.sub_pos),
steps as (select grp, pos, row_number() over (partition by grp, pos order by level) as k, is_right, sibling from path),
fold(grp, pos, k, h) as (
  select grp, pos, 0, coalesce(tampered, digest) from leaves union all
  select f.grp, f.pos, f.k + 1, sha256(case when s.is_right then s.sibling || f.h else f.h || s.sibling end)
  from fold f join steps s on s.grp = f.grp and s.pos = f.pos and s.k = f.k + 1),
ends as (select grp, pos, max_by(h, k) as h from fold group by grp, pos),
proofs as (select grp, pos, string_agg(sibling, '' order by k) as all_siblings from steps group by grp, pos)
select doc_id, w.digest as leaf, subroot, root, sha256(coalesce(all_siblings, '')) as proof_sha256, h as folded_root, h = root as verified
from whole w join ends using (grp, pos) left join proofs using (grp, pos)""",
    "op13_centroid_clusters": f"""
with {_centroid_rounds()},
d as (select v.vec_id, m[2]::int as cluster, m[1] as distance from a{ROUNDS} join v using (rn))
select vec_id, cluster, distance, (sum(distance) over (partition by cluster))::bigint as cluster_inertia,
       (sum(distance) over ())::bigint as inertia, sha256(array_to_string(c.v, ',')) as centroid_sha256
from d join c{ROUNDS} c on c.c = d.cluster""",
}
