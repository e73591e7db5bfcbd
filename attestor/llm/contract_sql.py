"""SQL of the quality rules, the manifest and the clustering, whose statements are made of steps."""

from __future__ import annotations

from .clustering import CLUSTERS, COMPONENTS, ROUNDS, SCALE, SEED
from .merkle import COLUMNS, FANOUT
from .repetition import MAX_COVERED, MAX_LONGEST, MAX_REPEAT_PERCENT, MIN_REPEAT, MIN_WORDS

BLANKS = "[^\\x20\\x09-\\x0D]"

#: A text's bytes as two hex digits each; a repeat is a string of MIN_REPEAT bytes that starts twice, and a longest repeat above
#: MAX_LONGEST a string of one byte more that does.
OP11_SQL = f"""
    with d as materialized (
        select row_number() over () as r, doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{BLANKS}+') as w from documents
    ), base as (
        select r, cast(len(w) as bigint) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
            cast(len(regexp_extract_all(t, '[#*$%&|<>]')) as bigint) as n_symbols,
            cast(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{BLANKS}')))
                - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{BLANKS}')))) as bigint) as n_dup_lines from d
    ), windows as materialized (
        select r, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) as g from (select r, w, unnest(range(1, len(w) - 1)) as i from d)
    ), again as (
        select r, i from windows join (select r, g from windows group by r, g having count(*) > 1) using (r, g)
    ), repeated as (
        select r, count(distinct i + k) as n from again cross join (select unnest(range(0, 3)) as k) group by r
    ), hexed as materialized (select r, hex(encode(t)) as h, strlen(t) as n from d
    ), grams as materialized (select r, p, hash(substr(h, 2 * p + 1, {2 * MIN_REPEAT})) as g from (select r, h, unnest(range(0, n - {MIN_REPEAT - 1})) as p from hexed)
    ), places as materialized (select r, p from grams join (select r, g from grams group by r, g having count(*) > 1) using (r, g)
    ), covered as (
        select r, sum(least({MIN_REPEAT}, coalesce(after, p + {MIN_REPEAT}) - p)) as b from (select r, p, lead(p) over (partition by r order by p) as after from places) group by r
    ), far as (
        select r, count(*) - count(distinct substr(h, 2 * p + 1, {2 * (MAX_LONGEST + 1)})) as n from places join hexed using (r) where p + {MAX_LONGEST + 1} <= n group by r
    )
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, cast(coalesce(repeated.n, 0) as bigint) as n_repeat_words, cast(hexed.n as bigint) as n_bytes,
        cast(coalesce(b, 0) as bigint) as covered_bytes,
        n_words < {MIN_WORDS} or 100 * coalesce(repeated.n, 0) > {MAX_REPEAT_PERCENT} * n_words as base_failed,
        not base_failed and coalesce(b, 0) <= {MAX_COVERED} * hexed.n and coalesce(far.n, 0) = 0 as kept
    from d join base using (r) join hexed using (r) left join repeated using (r) left join covered using (r) left join far using (r)
"""

#: Levels that the statement spells out: enough for 8 ** 9 rows of one part.
STEPS = 9

_CRC = """xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(coalesce(cast(doc_id as varchar), ''), ''),
    lambda c: list_concat([cast(unicode(c) as bigint)], [-1, -1, -1, -1, -1, -1, -1, -1])))),
    lambda s, o: case when o >= 0 then xor(s, o) else xor(s >> 1, case when s % 2 = 1 then 3988292384 else 0 end) end), 4294967295)"""


def _leaf(text: str) -> str:
    part = lambda c: f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')"
    return "sha256(" + " || ".join(part(text if c == "text" else c) for c in COLUMNS) + ")"


def _rise(name: str) -> str:
    """Levels `name`0, `name`1, ... of (k, pos, digest); a key whose node is alone stays as it is."""
    out = ""
    for s in range(STEPS):
        out += f""", {name}{s + 1} as materialized (
        select k, pos // {FANOUT} as pos, case when any_value(alone) then any_value(digest) else sha256(string_agg(digest, '' order by pos)) end as digest
        from (select *, count(*) over (partition by k) = 1 as alone from {name}{s}) group by k, pos // {FANOUT})"""
    return out


def _fall(name: str, rows: str) -> str:
    """`rows` (id, k, pos, proof, node) with the siblings of each level added to proof, and node folded."""
    out, at = "", rows
    for s in range(STEPS):
        out += f""", {name}_side{s} as materialized (
        select {at}.id, string_agg(n.digest, '' order by n.pos) filter (n.pos < {at}.pos) as l, string_agg(n.digest, '' order by n.pos) filter (n.pos > {at}.pos) as r, any_value(n.several) as several
        from {at} join (select *, count(*) over (partition by k) > 1 as several from {name}{s}) n on n.k = {at}.k and n.pos // {FANOUT} = {at}.pos // {FANOUT} group by {at}.id
    ), {name}_at{s + 1} as materialized (
        select id, k, pos // {FANOUT} as pos, proof || case when several then coalesce(l, '') || coalesce(r, '') else '' end as proof,
            case when several then sha256(coalesce(l, '') || node || coalesce(r, '')) else node end as node
        from {at} join {name}_side{s} using (id))"""
        at = f"{name}_at{s + 1}"
    return out


OP12_SQL = f"""
    with d as materialized (
        select row_number() over () as id, doc_id, coalesce('1' || lang, '0') as k, {_leaf("text")} as leaf,
            case when {_CRC} % 3 = 0 then {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} else {_leaf("text")} end as found from documents
    ), p0 as materialized (select id, k, row_number() over (partition by k order by doc_id nulls first, leaf) - 1 as pos, leaf as digest from d){_rise("p")}
    , l0 as materialized (select '' as k, row_number() over (order by k) - 1 as pos, digest, k as name from p{STEPS}){_rise("l")}
    , start as materialized (select p0.id, k, pos, '' as proof, found as node from p0 join d using (id, k)){_fall("p", "start")}
    , middle as materialized (select id, '' as k, l0.pos, proof, node from p_at{STEPS} a join l0 on l0.name = a.k){_fall("l", "middle")}
    select doc_id, leaf, l0.digest as subroot, l{STEPS}.digest as root, sha256(proof) as proof_sha256, node as folded_root, node = l{STEPS}.digest as verified
    from d join l_at{STEPS} using (id) join l0 on l0.name = d.k cross join l{STEPS}
"""


def _rounds() -> str:
    out = ""
    for s in range(ROUNDS + 1):
        out += f""", near{s} as materialized (
        select i, arg_min(c, (d, c)) as c, min(d) as d from (
            select i, c, cast(list_sum(list_transform(list_zip(v.x, m.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as bigint) as d from v cross join c{s} m) group by i)"""
        if s < ROUNDS:
            out += f""", c{s + 1} as materialized (
        select c, coalesce(y, x) as x from c{s} left join (
            select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by j) as y from (
                select c, j, cast(sum(x[j]) as bigint) as s, count(*) as n from v join near{s} using (i) cross join (select unnest(range(1, {COMPONENTS + 1})) as j) group by c, j) group by c) using (c))"""
    return out


OP13_SQL = f"""
    with v as materialized (
        select row_number() over () as i, vec_id, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as x from embeddings
        where len(embedding) = {COMPONENTS} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    ), c0 as materialized (
        select row_number() over (order by h, x) - 1 as c, x from (select x, sha256('{SEED}:' || coalesce(cast(vec_id as varchar), '')) as h from v) order by h, x limit {CLUSTERS}
    ){_rounds()}
    select vec_id, cast(c as integer) as cluster, d as distance, cast(sum(d) over (partition by c) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia,
        sha256(array_to_string(m.x, ',')) as centroid_sha256
    from v join near{ROUNDS} using (i) join c{ROUNDS} m using (c)
"""
