"""Shared pieces of the comparison SQL.

Named sub-queries over the given tables; ``query`` prefixes a statement with those it uses.
"""

from __future__ import annotations

import re

SPACE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}+', ' ', 'g'))"


def norm(x: str) -> str:
    return (
        f"regexp_replace(regexp_replace(lower({strip(x)}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
    )


def words(x: str) -> str:
    s = squeeze(f"coalesce({x}, '')")
    return f"(CASE WHEN {s} = '' THEN 0 ELSE len(string_split({s}, ' ')) END)"


def intent(x: str) -> str:
    return (
        f"(CASE WHEN lower({strip(x)}) LIKE 'hard:%' THEN 'hard' "
        f"WHEN lower({strip(x)}) LIKE 'validation:%' THEN 'validation' ELSE 'normal' END)"
    )


def base(x: str) -> str:
    s = strip(x)
    cut = lambda n: f"coalesce(nullif({strip(f'substr({s}, {n + 1})')}, ''), 'wide_variety')"
    return (
        f"(CASE WHEN lower({s}) LIKE 'hard:%' THEN {cut(5)} "
        f"WHEN lower({s}) LIKE 'validation:%' THEN {cut(11)} ELSE {s} END)"
    )


def explore(x: str) -> str:
    b = f"lower({base(x)})"
    return f"({b} = 'wide_variety' OR {b} LIKE 'wide\\_variety:%' ESCAPE '\\')"


def pick(seed: str, n: int | str) -> str:
    """0-based hash position."""
    return f"(('0x' || substr(sha256({seed}), 1, 12))::BIGINT % {n})"


def lits(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def markers(text: str, table: dict[str, int]) -> str:
    """List of markers found in lower-case text, in dictionary order."""
    cases = ", ".join(
        "CASE WHEN regexp_matches({t}, '(^|[^a-z0-9]){m}([^a-z0-9]|$)') THEN '{m}' END".format(t=text, m=m)
        for m in table
    )
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


def weight(hits: str, table: dict[str, int]) -> str:
    cases = " + ".join(f"CASE WHEN list_contains({hits}, '{m}') THEN {w} ELSE 0 END" for m, w in table.items())
    return f"({cases})"


def section(e: str) -> str:
    return f"'section_' || lpad(CAST(greatest({e} % 30 - 9, 0) AS VARCHAR), 3, '0')"


STATUS = (
    "CASE WHEN {a}recycle_count >= 2 THEN 'exhausted' "
    "WHEN NOT {a}active OR {a}retired_reason IS NOT NULL THEN 'retired' "
    "WHEN {now} - {a}last_recycled_round <= 1 THEN 'cooling_down' ELSE 'usable' END"
)


def status(now: str, a: str = "") -> str:
    return "(" + STATUS.format(now=now, a=a) + ")"


def rank_of(st: str) -> str:
    return f"(CASE {st} WHEN 'usable' THEN 4 WHEN 'cooling_down' THEN 3 WHEN 'exhausted' THEN 1 ELSE 0 END)"


def marked(source: str) -> str:
    """Vault rows with retirement rules applied."""
    reason = (
        "CASE WHEN loss < 0.15 THEN 'low_loss' WHEN recycle_count > 0 AND loss <= 0.35 THEN "
        "'low_loss_after_recycle' WHEN recycle_count >= 2 THEN 'max_recycle_count' END"
    )
    return (
        f"SELECT * REPLACE (active AND ({reason}) IS NULL AS active, "
        f"CASE WHEN ({reason}) IS NULL THEN retired_reason ELSE coalesce(retired_reason, {reason}) END AS retired_reason) "
        f"FROM {source}"
    )


PARTS: dict[str, str] = {
    "evals": f"""
        SELECT {section('event_id')} AS section_id, CAST(day(ts) AS INTEGER) - 1 AS round_id,
               event_id AS slot_id, props AS sample,
               'Explain the ' || event_type || ' event.' AS instruct,
               event_type || ' by user ' || user_id AS gold_summary,
               CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS token_length,
               CASE WHEN event_id % 97 = 0 THEN 'nan' WHEN event_id % 101 = 0 THEN NULL
                    WHEN event_id % 103 = 0 THEN 'inf' WHEN event_id % 107 = 0 THEN 'bad'
                    ELSE CAST(value / 97 AS VARCHAR) END AS loss,
               event_type AS tag,
               CASE WHEN (event_id // 30) % 10 < 3 THEN 'recycled' ELSE 'generated' END AS source,
               CASE WHEN (event_id // 30) % 10 < 3 AND event_id // 30 >= 7 THEN event_id - 210 END
                 AS source_ledger_id
        FROM events""",
    "ledger": """
        SELECT * EXCLUDE (slot_id) REPLACE (CAST(loss AS DOUBLE) AS loss), slot_id AS ledger_id FROM evals
        WHERE slot_id % 97 <> 0 AND slot_id % 101 <> 0 AND slot_id % 103 <> 0 AND slot_id % 107 <> 0""",
    "gen": "SELECT * FROM ledger WHERE source IS DISTINCT FROM 'recycled'",
    "rounds": "SELECT section_id, max(round_id) AS current_round FROM ledger GROUP BY 1",
    "messy": f"""
        SELECT event_id AS ledger_id, {section('event_id')} AS section_id,
               CASE event_id % 8 WHEN 0 THEN 'hard:' || event_type
                    WHEN 1 THEN ' Validation: ' || upper(event_type) || ' '
                    WHEN 2 THEN 'wide_variety:' || event_type WHEN 3 THEN 'HARD:'
                    WHEN 4 THEN '__' || upper(event_type[1]) || lower(event_type[2:]) || '--QA!! '
                    WHEN 5 THEN 'Wide Variety' WHEN 6 THEN 'good ' || event_type ELSE event_type END AS tag
        FROM events""",
    "pairs": """
        SELECT u.conv_id, u.turn, u.text AS instruct, a.text AS gold_summary
        FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
        WHERE u.role = 'user' AND a.role = 'assistant'""",
    "vault_rows": """
        SELECT g.*, r.current_round, row_number() OVER (PARTITION BY g.section_id ORDER BY loss DESC, ledger_id) AS pos
        FROM gen g JOIN rounds r USING (section_id) WHERE g.round_id < r.current_round""",
    "vault": """
        SELECT section_id, CAST(pos AS INTEGER) AS pos, ledger_id, tag, token_length,
               loss / (1 + pos % 4) AS loss, CAST(ledger_id % 3 AS INTEGER) AS recycle_count,
               CASE WHEN ledger_id % 3 > 0 THEN CAST(current_round - 1 - ledger_id % 4 AS INTEGER) END AS last_recycled_round,
               ledger_id % 7 <> 0 AS active,
               CASE WHEN ledger_id % 7 = 0 THEN 'low_loss' END AS retired_reason,
               round_id AS first_seen_round, CASE WHEN ledger_id % 5 <> 0 THEN round_id END AS last_seen_round,
               loss / (1 + pos % 4) AS last_loss,
               CASE WHEN ledger_id % 3 > 0 THEN loss / (1 + pos % 4) END AS best_recycle_loss
        FROM vault_rows WHERE pos <= 10""",
    "again": """
        SELECT section_id, ledger_id * 10 + s AS slot_id, token_length, loss * f AS loss,
               tag || '_again' AS tag, ledger_id AS source_ledger_id
        FROM vault JOIN (VALUES (0, 1, 0.5::DOUBLE), (0, 2, 0.2::DOUBLE), (1, 1, 0.9::DOUBLE)) AS x(m, s, f) ON pos % 3 = m""",
    "rescored": """
        SELECT v.section_id, v.pos, v.ledger_id,
               coalesce(l.tag, v.tag) AS tag, coalesce(l.token_length, v.token_length) AS token_length,
               coalesce(l.loss, v.loss) AS loss, v.recycle_count, v.last_recycled_round,
               CASE WHEN l.loss IS NULL THEN v.active
                    WHEN v.recycle_count >= 2 OR l.best <= 0.35 THEN false ELSE v.active END AS active,
               CASE WHEN l.loss IS NULL THEN v.retired_reason
                    WHEN v.recycle_count >= 2 THEN
                      CASE WHEN l.loss <= 0.35 THEN 'low_loss_after_recycle' ELSE 'max_recycle_count' END
                    WHEN l.best <= 0.35 THEN 'low_loss_after_recycle' ELSE v.retired_reason END AS retired_reason,
               CASE WHEN l.loss IS NULL THEN v.first_seen_round ELSE coalesce(v.first_seen_round, r.current_round) END AS first_seen_round,
               CASE WHEN l.loss IS NULL THEN v.last_seen_round ELSE r.current_round END AS last_seen_round,
               coalesce(l.loss, v.last_loss) AS last_loss,
               least(v.best_recycle_loss, l.best) AS best_recycle_loss
        FROM vault v JOIN rounds r USING (section_id)
        LEFT JOIN (SELECT section_id, source_ledger_id, arg_max(loss, slot_id) AS loss, arg_max(tag, slot_id) AS tag,
                          arg_max(token_length, slot_id) AS token_length, min(loss) AS best
                   FROM again GROUP BY 1, 2) l
          ON l.section_id = v.section_id AND l.source_ledger_id = v.ledger_id""",
    "incumbents": marked("rescored"),
    "round_rows": "SELECT g.* FROM gen g JOIN rounds r ON g.section_id = r.section_id AND g.round_id = r.current_round",
    "low_half": """
        SELECT section_id, avg(loss) AS lowest_half_avg
        FROM (SELECT section_id, loss, row_number() OVER (PARTITION BY section_id ORDER BY loss) AS rn,
                     count(*) OVER (PARTITION BY section_id) AS n FROM incumbents)
        WHERE rn <= greatest(1, n // 2) GROUP BY 1""",
    "thresholds": """
        SELECT r.section_id, a.round_avg, l.lowest_half_avg,
               greatest(0.35, least(a.round_avg, l.lowest_half_avg)) AS minimum_entry_loss
        FROM rounds r LEFT JOIN (SELECT section_id, avg(loss) AS round_avg FROM round_rows GROUP BY 1) a USING (section_id)
        LEFT JOIN low_half l USING (section_id)""",
    "candidates": """
        SELECT * FROM (
          SELECT c.*, row_number() OVER (PARTITION BY c.section_id ORDER BY c.loss DESC, c.ledger_id) AS cand_rank
          FROM round_rows c JOIN thresholds t USING (section_id)
          QUALIFY c.loss >= t.minimum_entry_loss OR (cand_rank <= 3 AND c.loss >= 0.35))
        WHERE cand_rank <= 10""",
    "admit_pool": f"""
        SELECT *, {rank_of(status('next_round'))} AS prio FROM (
          SELECT i.*, NULL::BIGINT AS cand_rank, r.current_round + 1 AS next_round
          FROM incumbents i JOIN rounds r USING (section_id)
          UNION ALL BY NAME
          SELECT c.section_id, NULL::INTEGER AS pos, c.ledger_id, c.tag, c.token_length, c.loss, 0 AS recycle_count,
                 NULL::INTEGER AS last_recycled_round, true AS active, NULL::VARCHAR AS retired_reason,
                 c.round_id AS first_seen_round, c.round_id AS last_seen_round, c.loss AS last_loss,
                 NULL::DOUBLE AS best_recycle_loss, c.cand_rank, r.current_round + 1 AS next_round
          FROM candidates c JOIN rounds r USING (section_id))""",
    "admitted": """
        SELECT * FROM (
          SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY prio DESC, loss DESC,
                   coalesce(last_seen_round, -1) DESC, cand_rank ASC NULLS FIRST, pos DESC) AS keep_rank FROM admit_pool)
        WHERE keep_rank <= 10""",
    "refills": f"""
        SELECT * FROM (
          SELECT g.*, u.usable, row_number() OVER (PARTITION BY g.section_id
                   ORDER BY g.loss DESC, g.round_id DESC, g.ledger_id) AS rn
          FROM gen g JOIN rounds r USING (section_id)
          LEFT JOIN (SELECT section_id, count(*) FILTER (WHERE {status('next_round')} = 'usable') AS usable
                     FROM admitted GROUP BY 1) u USING (section_id)
          WHERE g.round_id >= greatest(0, r.current_round - 2) AND g.loss >= 0.15
            AND NOT EXISTS (SELECT 1 FROM admitted a WHERE a.section_id = g.section_id AND a.ledger_id = g.ledger_id))
        WHERE rn <= 3 - coalesce(usable, 0)""",
    "refilled": """
        SELECT section_id, ledger_id, tag, token_length, loss, recycle_count, last_recycled_round, active,
               retired_reason, first_seen_round, last_seen_round, last_loss, best_recycle_loss
        FROM admitted a LEFT JOIN (SELECT section_id, count(*) AS added FROM refills GROUP BY 1) f USING (section_id)
        WHERE keep_rank <= 10 - coalesce(added, 0)
        UNION ALL
        SELECT section_id, ledger_id, tag, token_length, loss, 0, NULL, true, NULL, round_id, round_id, loss, NULL
        FROM refills""",
    "remarked": marked("refilled"),
    "new_vault": f"""
        SELECT m.*, CAST(row_number() OVER (PARTITION BY m.section_id
                 ORDER BY {rank_of(status('r.current_round + 1', 'm.'))} DESC, m.loss DESC, m.ledger_id) AS INTEGER) AS pos
        FROM remarked m JOIN rounds r USING (section_id)""",
    "health_in": """
        SELECT section_id, round_id, avg(loss) AS decision_loss,
               (round_id + CAST(substr(section_id, 9, 3) AS INTEGER)) % 5 <> 4 AS complete
        FROM ledger GROUP BY 1, 2""",
    "targets": """
        SELECT h.section_id, h.round_id, h.decision_loss, h.complete,
               coalesce(arg_min(p.round_id, (p.decision_loss, -p.round_id)), NULL) AS target_round,
               arg_min(p.decision_loss, (p.decision_loss, -p.round_id)) AS target_loss
        FROM health_in h LEFT JOIN health_in p
          ON p.section_id = h.section_id AND p.round_id BETWEEN h.round_id - 3 AND h.round_id - 1 AND p.complete
        GROUP BY 1, 2, 3, 4""",
    "health_steps": """
        SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY round_id) AS step FROM targets""",
    "health": """
        SELECT section_id, round_id, decision_loss, best, best_round, raw, raw_round, streak, override, rolled, action FROM (
        WITH RECURSIVE f AS (
          SELECT section_id, step, round_id, decision_loss, decision_loss AS best, round_id AS best_round,
                 decision_loss AS raw, round_id AS raw_round, 0 AS streak, NULL::INTEGER AS override,
                 NULL::INTEGER AS rolled, 'new_best' AS action
          FROM health_steps WHERE step = 1
          UNION ALL
          SELECT s.section_id, s.step, s.round_id, s.decision_loss,
                 CASE WHEN s.decision_loss < f.best * 0.97::DOUBLE THEN s.decision_loss ELSE f.best END,
                 CASE WHEN s.decision_loss < f.best * 0.97::DOUBLE THEN s.round_id ELSE f.best_round END,
                 least(f.raw, s.decision_loss),
                 CASE WHEN s.decision_loss < f.raw THEN s.round_id ELSE f.raw_round END,
                 CASE WHEN s.decision_loss > f.best * 1.03::DOUBLE
                      THEN CASE WHEN f.streak + 1 >= 2 AND s.target_round IS NOT NULL THEN 0 ELSE f.streak + 1 END
                      ELSE 0 END,
                 CASE WHEN s.decision_loss < f.best * 0.97::DOUBLE THEN NULL
                      WHEN s.decision_loss > f.best * 1.03::DOUBLE AND f.streak + 1 >= 2 AND s.target_round IS NOT NULL
                      THEN s.target_round ELSE f.override END,
                 CASE WHEN s.decision_loss > f.best * 1.03::DOUBLE AND f.streak + 1 >= 2 THEN s.target_round END,
                 CASE WHEN s.decision_loss < f.best * 0.97::DOUBLE THEN 'new_best'
                      WHEN s.decision_loss > f.best * 1.03::DOUBLE THEN
                        CASE WHEN f.streak + 1 >= 2 THEN
                          CASE WHEN s.target_round IS NOT NULL THEN 'rollback_next' ELSE 'rollback_unavailable' END
                        ELSE 'degraded' END
                      ELSE 'stable' END
          FROM f JOIN health_steps s ON s.section_id = f.section_id AND s.step = f.step + 1)
        SELECT * FROM f)""",
    "plateau": """
        SELECT section_id, round_id, round_id + 1 - best_round AS rounds_since_best,
               count(*) FILTER (WHERE action IN ('degraded', 'rollback_next')) OVER w3 AS recent_degraded,
               CASE WHEN row_number() OVER w < 2 THEN 0.0 ELSE least(1.0,
                 CASE WHEN round_id + 1 - best_round >= 3 THEN 0.45 ELSE 0 END
                 + CASE WHEN round_id + 1 - best_round >= 5 THEN 0.25 ELSE 0 END
                 + CASE WHEN count(*) FILTER (WHERE action IN ('degraded', 'rollback_next')) OVER w3 >= 1 THEN 0.25 ELSE 0 END
                 + CASE WHEN action = 'stable' AND round_id + 1 <> best_round THEN 0.10 ELSE 0 END) END::DOUBLE AS validation_plateau
        FROM health
        WINDOW w AS (PARTITION BY section_id ORDER BY round_id),
               w3 AS (PARTITION BY section_id ORDER BY round_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
    "easy": """
        SELECT section_id, round_id, count(*) AS record_count, avg(loss) AS avg_loss, max(loss) AS max_loss,
               list_sort(list(loss))[CAST(round_even((count(*) - 1) * 0.75, 0) AS BIGINT) + 1] AS p75_loss
        FROM gen GROUP BY 1, 2""",
    "easy_scored": """
        SELECT *, least(1.0, CASE WHEN avg_loss < 0.18 THEN 0.45 ELSE 0 END + CASE WHEN p75_loss < 0.35 THEN 0.35 ELSE 0 END
               + CASE WHEN max_loss < 0.5 THEN 0.2 ELSE 0 END)::DOUBLE AS easy_batch FROM easy""",
    "metrics": """
        SELECT section_id, tag, avg(loss) AS avg_loss, count(*) AS n, min(ledger_id) AS oldest_ledger_id
        FROM gen WHERE tag <> '' AND tag <> 'good' GROUP BY 1, 2""",
    "top_metrics": f"""
        SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY avg_loss DESC,
                 coalesce(nullif(oldest_ledger_id, 0), 1000000000000), n DESC, tag) AS metric_rank
        FROM metrics WHERE NOT {explore('tag')} QUALIFY metric_rank <= 6""",
    "shares": """
        SELECT *, 6 - count(*) OVER s AS rest, avg_loss / sum(avg_loss) OVER s * (6 - count(*) OVER s) AS raw
        FROM top_metrics WINDOW s AS (PARTITION BY section_id)""",
    "allocated": """
        SELECT section_id, metric_rank, tag, avg_loss,
               CAST(1 + floor(raw) + CASE WHEN row_number() OVER (PARTITION BY section_id
                 ORDER BY raw - floor(raw) DESC, avg_loss DESC, tag DESC) <= rest - sum(floor(raw)) OVER (PARTITION BY section_id)
                 THEN 1 ELSE 0 END AS INTEGER) AS slots
        FROM shares""",
    "plan": """
        SELECT section_id, list_concat(['wide_variety', 'wide_variety', 'wide_variety', 'wide_variety'],
               flatten(list(list_resize(CAST([] AS VARCHAR[]), slots, tag) ORDER BY metric_rank))) AS plan
        FROM allocated GROUP BY 1""",
    "state_counts": """
        SELECT section_id, tag, CASE WHEN tag = 'view' AND CAST(substr(section_id, 9, 3) AS INTEGER) % 2 = 0 THEN count(*) * 4
               WHEN length(tag) % 2 = 0 THEN count(*) + 5 ELSE count(*) // 2 END AS n
        FROM ledger GROUP BY section_id, tag
        UNION ALL SELECT DISTINCT section_id, 'Rare-Kind', 2 FROM ledger""",
    "sync_counts": """
        SELECT coalesce(s.section_id, l.section_id) AS section_id, coalesce(s.tag, l.tag) AS tag,
               greatest(coalesce(s.n, 0), coalesce(l.n, 0)) AS n
        FROM state_counts s FULL JOIN (SELECT section_id, tag, count(*) AS n FROM ledger GROUP BY 1, 2) l
          ON s.section_id = l.section_id AND s.tag = l.tag""",
    "categories": f"""
        SELECT section_id, {norm('tag')} AS tag, CAST(sum(n) AS BIGINT) AS n FROM sync_counts
        WHERE {norm('tag')} NOT IN ('', 'good', 'wide_variety') GROUP BY 1, 2""",
}


def query(sql: str) -> str:
    """The statement with the named sub-queries it needs, in order of use."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\b[a-z_0-9]+\b", text):
            if name in PARTS and name not in needed and re.search(rf"(FROM|JOIN|,)\s+{name}\b", text, re.I):
                visit(PARTS[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({PARTS[n]})" for n in needed) + "\n" + sql
