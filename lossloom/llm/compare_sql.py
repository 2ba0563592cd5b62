"""DuckDB SQL with the results of some of the registered queries."""

from __future__ import annotations

from lossloom.llm.secrets import MORE_RULES

_REACH = """
    pairs as (select x, y from links union all select y, x from links),
    reach as (select {id} as a, {id} as b from {table} union select r.a, e.y from reach r join pairs e on r.b = e.x),
    named as (select a as {id}, min(b) as component_id from reach group by 1)"""


def secrets_sql() -> str:
    """Spans of ``op3``: matches and the text between them give the places, as both come from left to right."""
    assign = "(?i)(?:password|passwd|secret|token|api_?key)[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
    rules = [("assign", assign, "length(value) >= 6"), ("access", "(AKIA[A-Z0-9]+)", "length(hit) >= 20"), ("hex", "([0-9a-f]+)", "length(hit) >= 24")]
    rules += [(r.kind, f"({r.consumes or r.expression})", f"regexp_full_match(hit, '{r.expression}')") for r in MORE_RULES]
    found = " union all ".join(
        f"""select doc_id, text, {k} as k, '{kind}' as kind, i, hits[i] as hit, start, value from (
          select doc_id, text, unnest(range(1, len(hits) + 1)) as i, hits, unnest(parts_at) as start, unnest(vals) as value from (
            select doc_id, text, hits, vals, list_transform(range(1, len(hits) + 1), lambda i:
              list_sum(list_transform(parts[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0)) as parts_at from (
              select doc_id, text, regexp_extract_all(text, '{pattern}', 0) as hits, regexp_extract_all(text, '{pattern}', 1) as vals,
                     string_split_regex(text, '{pattern}') as parts from texts where regexp_matches(text, '{pattern}')))) where {good}"""
        for k, (kind, pattern, good) in enumerate(rules)
    )
    mark = "kind || ':' || cast(start as bigint) || ':' || cast(start + length(hit) as bigint)"
    return f"""
    with texts as (select doc_id, coalesce(text, '') as text from documents), spans as ({found}),
    digests as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
      string_agg({mark}, ',' order by start, k) filter (k < 3) as base, string_agg({mark}, ',' order by start, k) as spans from spans group by 1)
    select t.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
      sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from texts t left join digests d using (doc_id)
    """


def similar_vectors_sql() -> str:
    """``op5`` by comparing all pairs, which a comparison on a small table may do."""
    return f"""
    with recursive vectors as (select vec_id, cast(embedding as double[]) as v from embeddings),
    links as (select a.vec_id as x, b.vec_id as y from vectors a join vectors b on a.vec_id < b.vec_id where list_cosine_similarity(a.v, b.v) >= 0.95), {_REACH.format(id='vec_id', table='vectors')},
    counts as (select x as vec_id, count(*) as n from pairs group by 1)
    select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept from named left join counts using (vec_id)
    """


def near_duplicates_sql(words: int = 4, percent: int = 80) -> str:
    """``op10`` by joining all shingles."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
    with recursive texts as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
    grams as (select distinct doc_id, unnest(case when len(w) >= {words} then list_transform(range(1, len(w) - {words} + 2), lambda i: array_to_string(w[i:i + {words - 1}], ' '))
      when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from texts),
    sizes as (select doc_id, count(*) as n from grams group by 1),
    shared as (select a.doc_id as x, b.doc_id as y, count(*) as c from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
    links as (select x, y from shared join sizes m on m.doc_id = x join sizes n on n.doc_id = y where 100 * c >= {percent} * (m.n + n.n - c)), {_REACH.format(id='doc_id', table='texts')}
    select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept from named left join sizes using (doc_id)
    """


def _crc32(text: str) -> str:
    """The unsigned CRC-32 of a short ASCII text, bit by bit."""
    step = "case when x % 2 = 1 then xor(x >> 1, 3988292384) else x >> 1 end"
    byte = f"list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda x, z: {step})"
    return f"xor(list_reduce([4294967295]::bigint[] || list_transform(string_split({text}, ''), lambda d: ord(d)::bigint), lambda c, b: {byte}), 4294967295)"


def merkle_sql(levels: int = 6) -> str:
    """``op13`` with every level of the trees as a table of its own; 16^6 leaves a source at most."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def leaf(text):
        cells = [f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in ("doc_id::varchar", "source", "lang", "n_chars::varchar", text)]
        return f"sha256({' || '.join(cells)})"

    def tree(name, path):
        made = []
        for k in range(levels):
            run = f"over (partition by sid, i // 16 order by i rows between"
            made.append(
                f"{name}s{k} as (select sid, i, coalesce(string_agg(h, '') {run} unbounded preceding and 1 preceding), '') as l,"
                f" coalesce(string_agg(h, '') {run} 1 following and unbounded following), '') as r from {name}{k} where n > 1)"
            )
            made.append(f"{name}{k + 1} as (select sid, i // 16 as i, (n + 15) // 16 as n, sha256(string_agg(h, '' order by i)) as h from {name}{k} where n > 1 group by 1, 2, 3)")
        return made

    def paths(name, first, sid, idx):
        made, last = [], first
        for k in range(levels):
            made.append(
                f"{name}p{k} as (select p.* replace (proof || coalesce(l || r, '') as proof, case when l is null then folded else sha256(l || folded || r) end as folded)"
                f" from {last} p left join {name}s{k} s on s.sid = p.{sid} and s.i = p.{idx} // {16**k})"
            )
            last = f"{name}p{k}"
        return made

    claim = f"case when {_crc32('doc_id::varchar')} % 5 = 0 then {leaf(f'''translate(text, '{upper}', '{upper.lower()}')''')} else {leaf('text')} end"
    parts = [
        f"rows as (select doc_id, dense_rank() over (order by source nulls first) - 1 as sid, {leaf('text')} as h, {claim} as claim from documents)",
        "placed as (select *, row_number() over (partition by sid order by doc_id nulls first, h) - 1 as i, count(*) over (partition by sid) as n, 0 as z from rows)",
        "g0 as (select sid, i, n, h from placed)", *tree("g", "sid"),
        f"subroots as ({' union all '.join(f'select sid, h from g{k} where n = 1' for k in range(levels + 1))})",
        "t0 as (select 0 as sid, sid as i, count(*) over () as n, h from subroots)", *tree("t", "z"),
        f"top as ({' union all '.join(f'select h from t{k} where n = 1' for k in range(levels + 1))})",
        "start as (select *, '' as proof, claim as folded from placed)", *paths("g", "start", "sid", "i"), *paths("t", f"gp{levels - 1}", "z", "sid"),
    ]
    return f"""
    with {', '.join(parts)}
    select doc_id, p.h as leaf, s.h as subroot, top.h as root, sha256(proof) as proof_sha256, folded as folded_root, folded = top.h as verified
    from tp{levels - 1} p join subroots s on s.sid = p.sid cross join top
    """


def prefix_trie_sql() -> str:
    """``op11`` with whole sequences as lists; a node is a list of turns."""
    return f"""
    with turns as (select conv_id, list(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')) order by turn nulls first, role, text) as own,
        list(length(coalesce(text, '')) order by turn nulls first, role, text) as chars from conversations where conv_id is not null group by 1),
    convs as (select *, {_crc32('conv_id::varchar')} % 6 as h, conv_id - conv_id % 100 as base from turns),
    built as (select c.conv_id, coalesce(b.own[1:c.h], []) || c.own[c.h + 1:] as seq, coalesce(b.chars[1:c.h], []) || c.chars[c.h + 1:] as chars from convs c left join turns b on b.conv_id = c.base),
    prefixes as (select conv_id, unnest(range(0, len(seq) + 1)) as depth, seq, chars from built),
    nodes as (select seq[1:depth] as node, depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(chars[depth]) as last,
        coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (len(seq) = depth), '') as ends from prefixes group by 1, 2),
    kids as (select node[1:depth - 1] as node, count(*) as n_children from nodes where depth > 0 group by 1),
    full_nodes as (select n.*, coalesce(n_children, 0) as n_children, p.conv_id as parent_conv_id from nodes n left join kids k on k.node = n.node left join nodes p on n.depth > 0 and p.node = n.node[1:n.depth - 1]),
    below as (select unnest(range(0, depth + 1)) as up, node, depth, n_convs, last, n_children from full_nodes),
    sums as (select node[1:up] as node, cast(sum(case when depth = 0 then 0 else (n_convs - 1) * last end) as bigint) as saved_tokens, count(*) filter (n_children = 0) as n_leaves from below group by 1)
    select f.conv_id, f.depth, f.parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, sha256(f.ends) as ends_sha256 from full_nodes f join sums s on s.node = f.node
    """
