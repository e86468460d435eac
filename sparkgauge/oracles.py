"""DuckDB SQL for the catalog's queries: written by means of its own, to be compared with what Spark gives."""

from __future__ import annotations

from .plans import exchange, seeds

B, A = "snap_syn_2026_01_31", "snap_syn_2026_02_28"

#: Fixed values, written down again so that a wrong one in the engine shows.
WEIGHTS = {"withdrawn_project": 40, "removed_project": 25, "completed_project": 35, "new_project": 30, "status_changed": 25, "target_cod_delayed": 25, "target_cod_accelerated": 20, "capacity_changed": 20, "fuel_type_changed": 15, "poi_changed": 15, "name_changed": 5}
STATUS_WORDS = ("anopr", "proposed", "pending", "directed", "approved", "accepted", "final", "order")
DEPTHS = (0, 5, 10, 15, 20, 25, 30, 40, 50)
PREFERENCE = ("eligible", "contingent", "ambiguous", "unsupported", "not_eligible")
CONTINGENT, UNSUPPORTED, FINAL = ("proposed", "pending", "directed", "needs_review"), ("context_only", "technical_evidence", "superseded"), ("approved", "final")
EQUIPMENT = {"large_load": ("Large Power Transformer", "HV Switchgear / GIS", "Medium-Voltage Switchgear", "Protection / Control / Metering Package", "Interconnection Facilities", "Commissioning / Testing Package"), "battery": ("GSU Transformer", "HV Switchgear / GIS", "Medium-Voltage Switchgear", "Protection / Control / Metering Package", "Interconnection Facilities", "Commissioning / Testing Package"), "solar_storage": ("GSU Transformer", "HV Switchgear / GIS", "Medium-Voltage Switchgear", "Protection / Control / Metering Package", "Interconnection Facilities", "Commissioning / Testing Package")}


def _values(rows, names: str) -> str:
    lit = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else repr(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS v({names})"


_DIFF = f""",
    b AS (SELECT * FROM rec WHERE snapshot_id = '{B}'), a AS (SELECT * FROM rec WHERE snapshot_id = '{A}'),
    j AS (SELECT b.queue_id AS bq, a.queue_id AS aq, coalesce(b.queue_id, a.queue_id) AS entity_id, b.normalized_status AS bs, a.normalized_status AS s, b.capacity_mw AS bm, a.capacity_mw AS m,
                 a.target_cod - b.target_cod AS days, b.project_name AS bn, a.project_name AS n, coalesce(a.county, b.county) AS county, b.normalized_fuel_type AS bf, a.normalized_fuel_type AS f, b.normalized_project_name AS bnn, a.normalized_project_name AS nn, b.point_of_interconnection AS bp, a.point_of_interconnection AS p FROM b FULL JOIN a ON a.queue_id = b.queue_id),
    ch AS (
        SELECT *, CASE s WHEN 'Withdrawn' THEN 'withdrawn_project' WHEN 'Completed' THEN 'completed_project' ELSE 'status_changed' END AS event_type, CASE s WHEN 'Withdrawn' THEN 'high' ELSE 'medium' END AS severity FROM j WHERE bq IS NOT NULL AND aq IS NOT NULL AND s IS DISTINCT FROM bs
        UNION ALL SELECT *, 'capacity_changed', 'medium' FROM j WHERE abs(m - bm) > greatest(5.0, 0.02 * greatest(abs(m), abs(bm)))
        UNION ALL SELECT *, CASE WHEN days > 0 THEN 'target_cod_delayed' ELSE 'target_cod_accelerated' END, CASE WHEN days > 0 THEN 'medium' ELSE 'info' END FROM j WHERE abs(days) > 90
        UNION ALL SELECT *, 'fuel_type_changed', 'medium' FROM j WHERE bq IS NOT NULL AND aq IS NOT NULL AND f IS DISTINCT FROM bf
        UNION ALL SELECT *, 'name_changed', 'info' FROM j WHERE bq IS NOT NULL AND aq IS NOT NULL AND nn IS DISTINCT FROM bnn
        UNION ALL SELECT *, 'poi_changed', 'medium' FROM j WHERE bq IS NOT NULL AND aq IS NOT NULL AND p IS DISTINCT FROM bp),
    ev AS (
        SELECT *, CASE WHEN event_type = 'capacity_changed' THEN m END AS capacity_after, CASE WHEN event_type LIKE 'target%' THEN days END AS delta_days FROM ch
        UNION ALL SELECT *, 'new_project', 'info', NULL, NULL FROM j WHERE bq IS NULL
        UNION ALL SELECT *, 'removed_project', 'warning', NULL, NULL FROM j WHERE aq IS NULL
        UNION ALL SELECT *, 'unchanged', 'info', NULL, NULL FROM j WHERE bq IS NOT NULL AND aq IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ch WHERE ch.entity_id = j.entity_id))"""

_EVENTS = f"""{_DIFF},
    wt AS (SELECT * FROM {_values(WEIGHTS.items(), 'event_type, weight')}),
    ce AS (
        SELECT ev.event_type, entity_id, coalesce(n, bn, entity_id) AS entity_or_provision, capacity_after, delta_days,
               round(weight + coalesce(least(30.0, log10(greatest(coalesce(nullif(m, 0), nullif(bm, 0)), 1.0)) * 10), 0)
                     + CASE WHEN ev.event_type = 'capacity_changed' THEN least(30.0, log10(greatest(abs(m - bm), 1.0)) * 10) ELSE 0 END
                     + CASE WHEN ev.event_type = 'target_cod_delayed' THEN CASE WHEN days > 365 THEN 15 WHEN days > 180 THEN 10 WHEN days > 90 THEN 5 ELSE 0 END ELSE 0 END
                     + CASE WHEN lower(county) IN ('nation d', 'nation bc') THEN 10 ELSE 0 END, 4) AS materiality_score
        FROM ev JOIN wt USING (event_type) WHERE ev.event_type <> 'unchanged'),
    he AS (SELECT *, event_type NOT IN ('ambiguous_match', 'name_changed', 'source_unchanged') AND materiality_score >= 20.0 AS is_hard_alert, false AS is_ambiguous, 1.0 AS confidence FROM ce)"""

_NATIONAL = """
    places AS (SELECT c_custkey, r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
    ends AS (SELECT l_orderkey, max(l_shipdate::DATE) AS last, count(*) AS lines FROM lineitem GROUP BY 1),
    nat AS (SELECT CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'operational' ELSE 'withdrawn' END AS q_status, r_name AS region, o_orderpriority AS type_clean, floor(o_totalprice)::DOUBLE AS mw_1,
                   CASE WHEN lines > 3 THEN 10.0 END AS mw_2, o_orderdate::DATE AS q_date, CASE WHEN o_orderstatus <> 'O' THEN last END AS fin
            FROM orders JOIN places ON c_custkey = o_custkey LEFT JOIN ends ON l_orderkey = o_orderkey)"""

#: Suppliers with twins before and copies after: ``cb``, ``ca`` (with the link each gets) and ``cev`` (events).
_CONTESTED = """WITH s AS (SELECT s_suppkey AS k, abs(floor(s_acctbal / 50))::DOUBLE AS mw FROM supplier),
    cb AS (SELECT k, 'sup_1-' || k AS record_id FROM s WHERE k % 29 <> 0 UNION ALL SELECT k, 'sup_1-' || k || '-T' FROM s WHERE k % 29 <> 0 AND k % 2 = 1),
    ca0 AS (SELECT k, mw, 'sup_2-' || k AS record_id, k % 3 <> 0 AS has_id FROM s WHERE k % 23 <> 0 UNION ALL SELECT k, mw, 'sup_2-' || k || '-C', false FROM s WHERE k % 23 <> 0 AND k % 4 = 0),
    ca AS (
        SELECT k, mw, record_id, has_id AND k % 29 <> 0 AS same_id,
               CASE WHEN k % 29 <> 0 THEN least(round((0.22 + 0.10 + 0.09 + 0.04 + 0.10 + 0.04 + 0.07 + CASE WHEN has_id THEN 0.38 ELSE 0 END
                   + CASE WHEN k % 7 <> 0 OR mw <= greatest(5.0, 0.04 * mw) THEN 0.10 WHEN mw <= greatest(10.0, 0.2 * mw) THEN 0.04 ELSE 0 END)::DOUBLE, 4), 1.0) END AS score,
               CASE WHEN k % 29 <> 0 THEN 'sup_1-' || k END AS before_id,
               CASE WHEN k % 29 = 0 THEN 'new' WHEN k % 2 = 1 AND NOT has_id THEN 'torn' WHEN k % 4 = 0 AND record_id NOT LIKE '%-C' THEN 'new' ELSE 'linked' END AS verdict FROM ca0),
    moved AS (SELECT *, k % 7 = 0 AND mw > greatest(5.0, 0.04 * mw) AS other_size, k % 5 = 0 AS other_name FROM ca WHERE verdict = 'linked'),
    cev AS (
        SELECT 'capacity_changed' AS event_type, 'medium' AS severity, before_id AS before_record_id, record_id AS after_record_id, score AS confidence FROM moved WHERE other_size
        UNION ALL SELECT 'name_changed', 'info', before_id, record_id, score FROM moved WHERE other_name
        UNION ALL SELECT 'unchanged', 'info', before_id, record_id, score FROM moved WHERE NOT other_size AND NOT other_name
        UNION ALL SELECT 'ambiguous_match', 'warning', NULL, record_id, score FROM ca WHERE verdict = 'torn'
        UNION ALL SELECT 'new_project', 'info', NULL, record_id, 0.9 FROM ca WHERE verdict = 'new'
        UNION ALL SELECT 'removed_project', 'warning', record_id, NULL, 1.0 FROM cb WHERE record_id NOT IN (SELECT before_id FROM ca WHERE verdict = 'linked'))"""

_CAPTURES = f"""
    cap AS (SELECT 'watch_' || user_id AS watch_source_id, event_id AS captured_at, user_id,
                   CASE WHEN event_id % 41 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 'a final notice' WHEN event_id % 5 = 0 THEN 'an order is pending' ELSE event_type END AS txt FROM events),
    hashed AS (SELECT *, sha256(txt) AS content_hash FROM cap),
    prev AS (SELECT *, last_value(content_hash IGNORE NULLS) OVER (PARTITION BY watch_source_id ORDER BY captured_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_content_hash,
                    list_filter({list(STATUS_WORDS)!r}, lambda w: contains(lower(coalesce(txt, '')), w)) AS kw FROM hashed),
    st AS (SELECT *, CASE WHEN content_hash IS NULL THEN 'failed' WHEN content_hash = previous_content_hash THEN 'unchanged' ELSE 'changed' END AS parse_status,
                  user_id % 4 <> 0 AND (list_contains(kw, 'final') OR (list_contains(kw, 'order') AND user_id % 3 = 0)) AS review FROM prev)"""

_SCENARIOS = f"""
    scn0 AS (
        SELECT c_custkey AS k, 'scn-' || c_custkey AS scenario_id, ['FERC', 'SPP', 'PJM', 'ERCOT', 'DEMO', 'OTHER'][(c_custkey % 6 + 1)::INT] AS jurisdiction, (c_custkey % 300 + 10)::DOUBLE AS peak_mw, (c_custkey % 11 * 5)::DOUBLE AS depth,
               (c_custkey % 4 + 1)::DOUBLE AS hours, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 5 <> 0 END AS disp, CASE WHEN c_custkey % 13 <> 0 THEN true END AS meter, c_custkey % 2 = 0 AS coloc,
               CASE WHEN c_custkey % 3 <> 0 THEN (c_custkey % 50 * 1000)::DOUBLE END AS val, c_custkey % 4 AS kind, CASE WHEN c_custkey % 19 <> 0 THEN (c_custkey % 5 * 100)::DOUBLE END AS kv, c_custkey % 3 AS strategy,
               CASE WHEN c_custkey % 10 = 0 THEN 'NOWHERE' ELSE 'SYN' END AS asked_market, array_to_string(list_transform(string_split(translate(n_name, '_0123456789', ' abcdefghij'), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS asked_county,
               ['Battery', 'Battery', 'Hybrid', 'Wind'][(c_custkey % 4 + 1)::INT] AS asked_fuel
        FROM customer JOIN nation ON n_nationkey = c_nationkey),
    rules AS (SELECT * FROM {_values([(i, r[0], r[1], r[4], r[5].get('market_or_jurisdiction'), r[5].get('peak_mw_threshold'), r[5].get('commitment_depth_pct_min'), r[5].get('curtailability_required', False), r[5].get('metering_or_control_required', False), r[5].get('colocation_required', False)) for i, r in enumerate(seeds.RULES)], 'pos, rule_id, rj, rule_status, place, min_mw, min_depth, curt, met, col')}),
    pts AS (SELECT * FROM {_values([(r[0], *p) for r in seeds.RULES if r[6] for p in r[6]], 'rule_id, pd, pdays')})"""


def _eligible(scenarios: str, keys: str) -> str:
    """``ap`` (scenario and rule with criteria), ``el`` (status) and ``best`` (the preferred of each ``keys``) over ``scenarios``."""
    return f""",
    ap AS (SELECT s.*, r.* FROM {scenarios} s JOIN rules r ON r.rj = CASE WHEN s.jurisdiction IN (SELECT rj FROM rules) THEN s.jurisdiction ELSE 'FERC' END),
    cr AS (SELECT *, (CASE WHEN curt AND disp IS NULL THEN 1 ELSE 0 END + CASE WHEN met AND meter IS NULL THEN 1 ELSE 0 END) AS missing,
                  (CASE WHEN place IS NOT NULL AND place <> jurisdiction THEN 1 ELSE 0 END + CASE WHEN peak_mw < min_mw THEN 1 ELSE 0 END + CASE WHEN depth < min_depth THEN 1 ELSE 0 END
                   + CASE WHEN curt AND NOT disp THEN 1 ELSE 0 END + CASE WHEN met AND NOT meter THEN 1 ELSE 0 END + CASE WHEN col AND NOT coloc THEN 1 ELSE 0 END) AS mismatched FROM ap),
    el AS (SELECT *, CASE WHEN missing > 0 THEN 'ambiguous' WHEN mismatched > 0 THEN 'not_eligible' WHEN rule_status IN {CONTINGENT} THEN 'contingent' WHEN rule_status IN {UNSUPPORTED} THEN 'unsupported'
                          WHEN rule_status IN {FINAL} THEN 'eligible' ELSE 'unsupported' END AS eligibility_status FROM cr),
    best AS (SELECT * FROM el QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY list_position({list(PREFERENCE)!r}, eligibility_status), pos) = 1),
    bn AS (SELECT *, coalesce(nullif(p75, 0), nullif(med, 0)) AS base, (SELECT max(pdays) FROM pts WHERE pts.rule_id = best.rule_id AND pd <= best.depth) AS delta FROM best),
    bf AS (SELECT *, CASE WHEN conf = 'Insufficient' OR base IS NULL THEN 'insufficient_baseline' WHEN eligibility_status = 'ambiguous' THEN 'contingent' WHEN eligibility_status IN ('not_eligible', 'unsupported') THEN 'unsupported'
                          WHEN rule_status NOT IN {FINAL} THEN 'contingent' WHEN delta IS NULL THEN 'qualitative_only' ELSE 'quantified' END AS benefit_status FROM bn),
    be AS (SELECT *, CASE WHEN benefit_status = 'quantified' THEN round(least(delta, base), 2) END AS days FROM bf)"""


_COST = "peak_mw * depth / 100.0 * hours * 20"
_USD = f"({_COST}) * 1000.0 / 0.7 * (0.55 * 0.25 + 0.20 * 0.75 + 0.25 * 4.0)"

_LEAD = """
    lead0 AS (SELECT 'lead-' || p_partkey AS lead_time_id, ['Large Power Transformer', 'HV Switchgear / GIS', 'Medium-Voltage Switchgear', 'GSU Transformer', 'Interconnection Facilities'][(p_partkey % 5 + 1)::INT] AS equipment_class, p_brand AS band,
                     (p_partkey % 20 + 6)::DOUBLE AS low, (p_partkey % 20 + 6 + p_size % 30)::DOUBLE AS high, (DATE '2026-05-01' - to_months((p_partkey % 30)::INT))::DATE AS as_of, ['high', 'medium', 'low'][(p_partkey % 3 + 1)::INT] AS confidence, p_partkey % 9 <> 0 AS sourced FROM part),
    ld AS (SELECT *, (2026 - year(as_of)) * 12 + 6 - month(as_of) >= 18 AS is_stale FROM lead0)"""

_SCOPE = f""",
    classes AS (SELECT * FROM {_values([(k, i, c, c == 'HV Switchgear / GIS') for k, items in EQUIPMENT.items() for i, c in enumerate(items)], 'kind_name, i, equipment_class, big')}),
    scoped AS (SELECT scenario_id, i, equipment_class FROM scn JOIN classes ON kind_name = ['large_load', 'battery', 'solar_storage', '-'][(kind + 1)::INT] WHERE kv > 0 AND (NOT big OR kv >= 230 OR peak_mw >= 100)),
    placed AS (SELECT scenario_id, row_number() OVER (PARTITION BY scenario_id ORDER BY i) - 1 AS position, equipment_class FROM scoped),
    scope AS (SELECT scn.scenario_id, position, equipment_class FROM scn LEFT JOIN placed USING (scenario_id))"""

_PATH = """,
    hits AS (SELECT s.scenario_id, s.position, s.equipment_class, low, high, list_position(['low', 'medium', 'high'], confidence) AS rk, is_stale FROM scope s JOIN ld USING (equipment_class) WHERE sourced),
    cls AS (SELECT scenario_id, equipment_class, min(position) AS position, min(low) AS low, max(high) AS high, min(rk) AS rk, bool_or(is_stale) AS stale, count(DISTINCT (low, high)) > 1 AS conflict, count(*) AS n FROM hits GROUP BY ALL),
    pick AS (SELECT * FROM cls QUALIFY row_number() OVER (PARTITION BY scenario_id ORDER BY high DESC, rk, position) = 1),
    agg AS (SELECT scenario_id, min(rk) AS rk, bool_or(stale) AS stale, bool_or(conflict) AS conflict, sum(n)::BIGINT AS n FROM cls GROUP BY 1),
    miss AS (SELECT scenario_id, string_agg(DISTINCT equipment_class, ',' ORDER BY equipment_class) AS missing FROM scope WHERE equipment_class IS NOT NULL AND equipment_class NOT IN (SELECT equipment_class FROM ld WHERE sourced) GROUP BY 1),
    path AS (
        SELECT scn.scenario_id, pick.equipment_class AS binding_equipment_class, pick.low AS binding_lead_time_low_months, pick.high AS binding_lead_time_high_months, round(pick.low * 30.4375, 2) AS procurement_low_days, round(pick.high * 30.4375, 2) AS procurement_high_days,
               CASE WHEN pick.high IS NULL THEN 'insufficient' ELSE ['low', 'medium', 'high'][agg.rk] END AS procurement_confidence, coalesce(agg.stale, false) AS stale_flag, coalesce(agg.conflict, false) AS conflict_flag, pick.high IS NULL AS unsupported_flag,
               coalesce(missing, '') AS missing_equipment, coalesce(agg.n, 0) AS lead_time_rows
        FROM scn LEFT JOIN pick USING (scenario_id) LEFT JOIN agg USING (scenario_id) LEFT JOIN miss USING (scenario_id))"""

_ESTIMATE = """,
    x AS (SELECT be.*, path.* EXCLUDE (scenario_id), CASE WHEN conf <> 'Insufficient' AND med IS NOT NULL THEN med END AS bl, CASE WHEN conf <> 'Insufficient' AND med IS NOT NULL THEN greatest(p75, med) END AS bh FROM be JOIN path USING (scenario_id)),
    y AS (SELECT *, CASE WHEN days IS NOT NULL AND bl IS NOT NULL THEN greatest(0.0, bl - days) END AS fl, CASE WHEN days IS NOT NULL AND bl IS NOT NULL THEN greatest(greatest(0.0, bl - days), bh - days) END AS fh,
                 procurement_low_days AS pl, procurement_high_days AS ph FROM x)"""


def all_sql(adapter: str) -> dict[str, str]:
    rec = lambda select, more="": f"WITH {adapter}{more} {select}"
    scopes = """,
    latest AS (SELECT * FROM rec WHERE snapshot_id = 'snap_syn_2026_02_28'),
    du AS (SELECT *, CASE normalized_status WHEN 'Completed' THEN actual_cod - request_date WHEN 'Withdrawn' THEN withdrawn_date - request_date END AS days FROM latest),
    sc AS (SELECT CASE grouping(county) WHEN 0 THEN CASE grouping(normalized_fuel_type) WHEN 0 THEN 'county_fuel' ELSE 'county_all_fuels' END ELSE CASE grouping(normalized_fuel_type) WHEN 0 THEN 'market_fuel' ELSE 'market_all' END END AS fallback_level,
                  county, normalized_fuel_type AS fuel_type, count(*) AS sample_n, count(*) FILTER (normalized_status = 'Active') AS active_count, coalesce(sum(capacity_mw) FILTER (normalized_status = 'Active'), 0)::DOUBLE AS active_mw,
                  count(*) FILTER (normalized_status = 'Completed') AS completed_count, count(*) FILTER (normalized_status = 'Withdrawn') AS withdrawn_count, quantile_cont(days, 0.5) AS median_duration_days, quantile_cont(days, 0.75) AS p75_duration_days
           FROM du GROUP BY GROUPING SETS ((county, normalized_fuel_type), (county), (normalized_fuel_type), ()))"""

    def rolled(least: int, extra: str = "") -> str:
        return rec(
            f"""SELECT request_id, market, CASE WHEN sc.sample_n IS NULL THEN CASE market WHEN 'SYN' THEN 'lbnl_national' ELSE 'requested' END WHEN fallback_level LIKE 'county%' THEN 'county' ELSE 'market' END AS scope_type,
                CASE WHEN sc.sample_n IS NULL THEN CASE market WHEN 'SYN' THEN 'US queues' ELSE rq.county END WHEN fallback_level LIKE 'county%' THEN rq.county ELSE 'SYN' END AS scope_value,
                CASE WHEN sc.sample_n IS NULL AND market <> 'SYN' THEN rq.fuel ELSE sc.fuel_type END AS fuel_type, coalesce(sample_n, 0) AS sample_n, coalesce(active_count, 0) AS active_count, coalesce(active_mw, 0) AS active_mw,
                coalesce(completed_count, 0) AS completed_count, coalesce(withdrawn_count, 0) AS withdrawn_count, round(completed_count / sample_n, 4) AS completion_rate, round(withdrawn_count / sample_n, 4) AS withdrawal_rate, median_duration_days, p75_duration_days,
                CASE WHEN sample_n IS NULL THEN 'Insufficient' WHEN sample_n >= 100 THEN 'High' WHEN sample_n >= 30 THEN 'Medium' ELSE 'Low' END AS confidence, coalesce(fallback_level, CASE market WHEN 'SYN' THEN 'lbnl_national_all' ELSE 'none' END) AS fallback_level,
                CASE market WHEN 'SYN' THEN 'snap_syn_2026_02_28' END AS source_snapshot_id
            FROM rq LEFT JOIN (SELECT request_id AS rid, sc.* FROM rq JOIN sc ON market = 'SYN' AND sample_n >= {least} AND ((fallback_level = 'county_fuel' AND sc.county = rq.county AND sc.fuel_type = rq.fuel) OR (fallback_level = 'county_all_fuels' AND sc.county = rq.county)
                    OR (fallback_level = 'market_fuel' AND sc.fuel_type = rq.fuel) OR fallback_level = 'market_all')
                QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY list_position(['county_fuel', 'county_all_fuels', 'market_fuel', 'market_all'], fallback_level)) = 1) sc ON rid = request_id""",
            f"{scopes}, rq AS (SELECT DISTINCT 'SYN|' || county || '|' || normalized_fuel_type AS request_id, 'SYN' AS market, county, normalized_fuel_type AS fuel FROM latest{extra})",
        )

    labels = """,
    au AS (SELECT entity_id, bq, aq, n, bs, s, 'auto_verified_exact_id' AS system_label FROM j WHERE bq IS NOT NULL AND aq IS NOT NULL
           UNION ALL SELECT entity_id, CASE WHEN event_type <> 'new_project' THEN bq END, aq, n, CASE WHEN event_type <> 'new_project' THEN bs END, s,
                  CASE event_type WHEN 'new_project' THEN 'system_suggested_true_new' WHEN 'removed_project' THEN 'system_suggested_true_removed_not_withdrawn' WHEN 'withdrawn_project' THEN 'system_suggested_true_withdrawn'
                       WHEN 'completed_project' THEN 'system_suggested_true_completed' WHEN 'fuel_type_changed' THEN 'possible_reclassification' WHEN 'name_changed' THEN 'possible_id_name_drift' ELSE 'system_suggested_' || event_type END FROM ev WHERE event_type NOT IN ('unchanged', 'poi_changed'))"""
    fuels = "CASE WHEN contains(f, 'hybrid') OR contains(f, 'pv+bess') THEN 'Hybrid' WHEN contains(f, 'battery') OR contains(f, 'bess') OR contains(f, 'storage') OR contains(f, 'ess') THEN 'Battery' WHEN contains(f, 'solar') OR contains(f, 'pv') THEN 'Solar' WHEN contains(f, 'wind') THEN 'Wind' WHEN contains(f, 'gas') OR contains(f, 'ct') THEN 'Gas' ELSE 'Other' END"
    scn = lambda select, more="": f"WITH {_SCENARIOS}, scn AS (SELECT *, NULL::VARCHAR AS conf, NULL::DOUBLE AS med, NULL::DOUBLE AS p75 FROM scn0){more} {select}"
    measured = """, scn AS (
        SELECT scn0.*, CASE WHEN sample_n IS NULL THEN 'Insufficient' WHEN sample_n >= 100 THEN 'High' WHEN sample_n >= 30 THEN 'Medium' ELSE 'Low' END AS conf, median_duration_days AS med, p75_duration_days AS p75
        FROM scn0 LEFT JOIN sc ON asked_market = 'SYN' AND sample_n >= 30 AND CASE fallback_level WHEN 'county_fuel' THEN county = asked_county AND fuel_type = asked_fuel WHEN 'county_all_fuels' THEN county = asked_county WHEN 'market_fuel' THEN fuel_type = asked_fuel ELSE true END
        QUALIFY row_number() OVER (PARTITION BY scenario_id ORDER BY list_position(['county_fuel', 'county_all_fuels', 'market_fuel', 'market_all'], fallback_level)) = 1)"""
    rated = lambda select, more="": f"WITH {adapter}{scopes}, {_SCENARIOS.strip()}{measured}{more} {select}"
    levels = f", lv AS (SELECT scn.* REPLACE (l::DOUBLE AS depth) FROM scn, (SELECT unnest({list(DEPTHS)!r}) AS l))"
    net = f"CASE WHEN benefit_status = 'quantified' AND val IS NOT NULL THEN round(round(days * val - round({_USD}, 2), 2), 0) END"
    swept = f"{levels}{_eligible('lv', 'scenario_id, depth')}"
    path = f", {_LEAD.lstrip()}{_SCOPE}{_PATH}"
    serial = lambda a, p, c, b: f"round({a} + {p} + {c} + {b}, 2)"
    over = lambda a, p, c, b: f"CASE WHEN {a} IS NOT NULL AND {p} IS NOT NULL THEN round(greatest({a}, {p}) + {c} + {b}, 2) END"
    total = {"no_flex_serial_low_days": serial("bl", "pl", 30, 7), "no_flex_serial_high_days": serial("bh", "ph", 60, 14), "flex_serial_low_days": serial("fl", "pl", 30, 7), "flex_serial_high_days": serial("fh", "ph", 60, 14), "no_flex_overlap_low_days": over("bl", "pl", 30, 7), "no_flex_overlap_high_days": over("bh", "ph", 60, 14), "flex_overlap_low_days": over("fl", "pl", 30, 7), "flex_overlap_high_days": over("fh", "ph", 60, 14)}
    estimates = f"{_eligible('scn', 'scenario_id')}{path}{_ESTIMATE}"
    parts = [("interconnection_baseline", "bl", "bh", "metric_rollup"), ("flexibility_adjustment", "CASE WHEN fl IS NOT NULL THEN -days END", "CASE WHEN fl IS NOT NULL THEN -days END", "flexibility_rule"), ("interconnection_with_flex", "fl", "fh", "flexibility_rule"), ("procurement_critical_path", "pl", "ph", "equipment_lead_times"), ("commissioning", "30.0", "60.0", "commissioning_assumption"), ("energization_buffer", "7.0", "14.0", "commissioning_assumption"), ("total_serial", total["no_flex_serial_low_days"], total["no_flex_serial_high_days"], "calculation"), ("total_overlap", total["no_flex_overlap_low_days"], total["no_flex_overlap_high_days"], "calculation")]
    records = rec("SELECT snapshot_id, queue_id, project_name, normalized_project_name, county, state, point_of_interconnection, fuel_type, normalized_fuel_type, capacity_mw, normalized_status, request_date, target_cod, actual_cod, withdrawn_date FROM rec")
    return exchange.SQL | {
        "normalize_records": records,
        "csv_records": records,
        "independent_checks": f"""WITH {adapter}, {_NATIONAL.strip()}, m(metric, v) AS (
            SELECT 'row_count/' || snapshot_id, count(*)::DOUBLE FROM rec GROUP BY snapshot_id
            UNION ALL SELECT 'missing_key_fields/' || snapshot_id, count(*) FILTER (project_name IS NULL) FROM rec GROUP BY snapshot_id
            UNION ALL SELECT 'status_count/' || snapshot_id || '/' || normalized_status, count(*) FROM rec GROUP BY snapshot_id, normalized_status
            UNION ALL SELECT 'active_capacity_by_fuel/' || snapshot_id || '/' || normalized_fuel_type, round(sum(capacity_mw), 2) FROM rec WHERE normalized_status = 'Active' GROUP BY snapshot_id, normalized_fuel_type
            UNION ALL SELECT 'queue_id_overlap/snap_syn_2026_01_31 & snap_syn_2026_02_28', count(*) FROM rec a JOIN rec b USING (queue_id) WHERE a.snapshot_id < b.snapshot_id
            UNION ALL SELECT 'national/projects', count(*) FROM nat UNION ALL SELECT 'national/active', count(*) FROM nat WHERE q_status = 'active'
            UNION ALL SELECT 'national/active_gw', round(sum(mw_1) / 1000, 4) FROM nat WHERE q_status = 'active' UNION ALL SELECT 'national/region_active', count(*) FROM nat WHERE q_status = 'active' AND region = 'ASIA'
            UNION ALL SELECT 'national/median_days', round(median(fin - q_date), 2) FROM nat)
            SELECT metric, v AS calculated, v AS official, 0.0::DOUBLE AS delta, 'matched_within_tolerance' AS status FROM m""",
        "reconciled_orders": """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 97 <> 0 AS there, o_orderkey % 79 = 0 AS twice, o_orderkey % 89 = 0 AS price, o_orderkey % 83 = 0 AND o_orderpriority IS NOT NULL AS priority FROM orders)
            SELECT k AS o_orderkey, CASE WHEN NOT there THEN 'only_left' WHEN twice THEN 'other_rows' ELSE 'other_values' END AS verdict, 1 AS left_rows, CASE WHEN NOT there THEN 0 WHEN twice THEN 2 ELSE 1 END AS right_rows,
                   CASE WHEN NOT there OR twice THEN '' ELSE concat_ws(',', CASE WHEN price THEN 'o_totalprice' END, CASE WHEN priority THEN 'o_orderpriority' END) END AS columns FROM o WHERE NOT there OR twice OR price OR priority
            UNION ALL SELECT -o_orderkey - 1, 'only_right', 0, 1, '' FROM orders WHERE o_orderkey % 101 = 0""",
        "csv_snapshots": f"WITH {adapter} SELECT 'SYN' AS market, snapshot_id, snapshot_date, count(*) AS row_count, true AS hashed FROM raw GROUP BY ALL",
        "quality_flag_counts": rec("SELECT snapshot_id, flag, count(*) AS records FROM (SELECT snapshot_id, unnest(list_filter([CASE WHEN fuel_type IS NULL THEN 'unclear_fuel_type:missing' END, CASE WHEN capacity_mw <= 0 THEN 'missing_or_nonpositive_capacity_mw' END, CASE WHEN project_name IS NULL THEN 'missing_project_name' END, CASE WHEN normalized_status = 'Unknown' THEN 'unclear_status:' || raw_status END], lambda x: x IS NOT NULL)) AS flag FROM rec) GROUP BY ALL"),
        "status_counts": rec("SELECT snapshot_id, normalized_status, normalized_fuel_type, count(*) AS records, round(sum(capacity_mw), 2) AS mw FROM rec GROUP BY ALL"),
        "source_snapshot_counts": "SELECT c_custkey AS source_id, c_name AS source_name, count(o_orderkey) AS snapshots FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL",
        "keyword_guard": f"SELECT doc_id, array_to_string(list_filter({list(STATUS_WORDS)!r}, lambda w: contains(lower(coalesce(text, '')), w)), ',') AS keywords, len(list_filter(['data center', 'large load', 'load', 'ai campus'], lambda w: contains(lower(coalesce(text, '')), w))) > 0 AS large_load FROM documents",
        "text_functions": f"""SELECT p_partkey, replace(replace(replace(lower(p_name || ' / X-' || p_brand), ' ', '_'), '/', ''), '-', '_') AS slug, p_name || ' x' AS compact, 1000.0 + p_size AS mw, CASE WHEN p_size % 2 = 0 THEN 'TX' ELSE substr(p_type, 1, 2) END AS state,
            {fuels} AS fuel, CASE p_size % 3 WHEN 0 THEN 'Suspended' WHEN 1 THEN 'Completed' ELSE 'Unknown' END AS status, regexp_replace(p_brand, '^Brand#', '') AS brand FROM (SELECT *, lower(p_type || ' project') AS f FROM part)""",
        "rollup_scopes": rec("SELECT 'SYN' AS market, 'snap_syn_2026_02_28' AS source_snapshot_id, * FROM sc", scopes),
        "rollup_precompute": rolled(2),
        "rollup_fallback": rolled(100, " UNION ALL SELECT 'none', 'NOWHERE', 'Elsewhere', 'Solar'"),
        "national_metrics": f"""WITH {_NATIONAL} SELECT count(*) AS projects, count(*) FILTER (q_status = 'active') AS active, round(coalesce(sum(mw_1) FILTER (q_status = 'active'), 0) / 1000, 4) AS active_gw, round(coalesce(sum(mw_1 + coalesce(mw_2, 0)) FILTER (q_status = 'active'), 0) / 1000, 4) AS active_gw_all,
            count(*) FILTER (q_status = 'active' AND region = 'ASIA') AS region_active, round(coalesce(sum(mw_1) FILTER (q_status = 'active' AND region = 'ASIA'), 0) / 1000, 4) AS region_active_gw, round(median(fin - q_date) FILTER (q_status <> 'active'), 2) AS median_days FROM nat""",
        "national_by_type": f"WITH {_NATIONAL} SELECT type_clean, count(*) AS active_rows, round(sum(mw_1) / 1000, 4) AS capacity_gw FROM nat WHERE q_status = 'active' GROUP BY 1",
        "snapshot_diff": rec(f"SELECT 'SYN' AS market, '{B}' AS from_snapshot_id, '{A}' AS to_snapshot_id, entity_id, event_type, severity, 1.0::DOUBLE AS confidence, delta_days::INT AS delta_days, capacity_after FROM ev", _DIFF),
        "diff_counts": rec("SELECT event_type, count(*) AS events FROM ev GROUP BY 1", _DIFF),
        "change_events": rec("SELECT event_type, entity_id, entity_or_provision, materiality_score, is_hard_alert, is_ambiguous, confidence::DOUBLE AS confidence FROM he", _EVENTS),
        "hard_alerts": rec("SELECT event_type, entity_id, max(materiality_score) AS materiality_score FROM (SELECT * FROM he UNION ALL SELECT * REPLACE (materiality_score + CASE WHEN event_type = 'new_project' THEN 1 ELSE -1 END AS materiality_score) FROM he WHERE event_type IN ('new_project', 'capacity_changed')) WHERE is_hard_alert GROUP BY ALL", _EVENTS),
        "top_alerts": rec("SELECT event_type, entity_or_provision, entity_id, materiality_score FROM he WHERE is_hard_alert ORDER BY materiality_score DESC, event_type, entity_or_provision, entity_id LIMIT 25", _EVENTS),
        "digest_sections": rec("SELECT 'queue' AS event_domain, event_type, count(*) AS events, count(*) FILTER (is_hard_alert) AS hard_alerts FROM he GROUP BY ALL", _EVENTS),
        "entity_dimension": rec("SELECT queue_id AS entity_id, min(snapshot_date) AS first_seen, max(snapshot_date) AS last_seen, count(*) AS records, arg_max(project_name, snapshot_date) AS project_name, arg_max(county, snapshot_date) AS county, arg_max(normalized_fuel_type, snapshot_date) AS normalized_fuel_type, arg_max(capacity_mw, snapshot_date) AS capacity_mw, arg_max(normalized_status, snapshot_date) AS normalized_status FROM rec GROUP BY 1"),
        "entity_audit": rec("SELECT entity_id, coalesce(bq, '') AS queue_id_before, coalesce(aq, '') AS queue_id_after, coalesce(n, '') AS project_name_after, coalesce(bs, '') AS status_before, coalesce(s, '') AS status_after, system_label, 1.0::DOUBLE AS match_score, 'x' AS source_file_hash_before FROM au", _DIFF + labels),
        "entity_audit_counts": rec("SELECT count(*) FILTER (system_label = 'auto_verified_exact_id') AS exact_matches, 0::BIGINT AS fuzzy_matches, 0::BIGINT AS ambiguous_matches, count(*) FILTER (system_label = 'system_suggested_true_new') AS true_additions, count(*) FILTER (system_label = 'system_suggested_true_removed_not_withdrawn') AS true_removals_or_missing, count(*) FILTER (system_label = 'system_suggested_true_withdrawn') AS true_withdrawals, count(*) FILTER (system_label = 'system_suggested_true_completed') AS true_completed, count(*) FILTER (system_label = 'possible_reclassification') AS reclassifications FROM au", _DIFF + labels),
        "id_overlap": rec(f"SELECT queue_id FROM rec WHERE snapshot_id = '{B}' INTERSECT SELECT queue_id FROM rec WHERE snapshot_id = '{A}'"),
        "comparables": rec(f"SELECT queue_id, project_name, capacity_mw, abs(capacity_mw - 150.0) AS capacity_distance_mw, year(target_cod) = 2000 AS target_cod_year_match, normalized_status FROM rec WHERE snapshot_id = '{A}' AND normalized_fuel_type = 'Solar' ORDER BY capacity_distance_mw, target_cod_year_match DESC, normalized_status, capacity_mw DESC, project_name, queue_id LIMIT 10"),
        "resolve_links": """WITH s AS (SELECT s_suppkey AS k, abs(floor(s_acctbal / 50))::DOUBLE AS mw FROM supplier),
            m AS (SELECT k, 0.22 + 0.10 + 0.09 + 0.04 + 0.10 + 0.04 + CASE WHEN k % 3 <> 0 THEN 0.38 ELSE 0 END
                            + CASE WHEN k % 7 <> 0 OR mw <= greatest(5.0, 0.04 * mw) THEN 0.10 WHEN mw <= greatest(10.0, 0.2 * mw) THEN 0.04 ELSE 0 END AS score FROM s)
            SELECT 'sup_1-' || k AS record_id, 'sup_1' AS snapshot_id, 1.0::DOUBLE AS match_score, 'first_snapshot_seed' AS match_method, false AS is_ambiguous, NULL AS candidate_record_id FROM s WHERE k % 29 <> 0
            UNION ALL SELECT 'sup_2-' || k, 'sup_2', CASE WHEN k % 29 <> 0 THEN least(round(score::DOUBLE, 4), 1.0) END, CASE WHEN k % 29 = 0 THEN 'new_entity' WHEN score >= 0.76 THEN 'high_confidence_match' ELSE 'possible_match' END,
                             false, CASE WHEN k % 29 <> 0 THEN 'sup_1-' || k END FROM m WHERE k % 23 <> 0""",
        "contested_links": f"""{_CONTESTED} SELECT record_id, 'sup_1' AS snapshot_id, 1.0::DOUBLE AS match_score, 'first_snapshot_seed' AS match_method, false AS is_ambiguous, NULL AS candidate_record_id FROM cb
            UNION ALL SELECT record_id, 'sup_2', score, CASE verdict WHEN 'linked' THEN CASE WHEN score >= 0.76 THEN 'high_confidence_match' ELSE 'possible_match' END WHEN 'torn' THEN 'ambiguous_possible_match' ELSE 'new_entity' END, verdict = 'torn', before_id FROM ca""",
        "contested_diff": f"{_CONTESTED} SELECT event_type, severity, before_record_id, after_record_id, confidence FROM cev",
        "contested_audit_counts": f"""{_CONTESTED} SELECT count(*) FILTER (label = 'id') AS exact_matches, count(*) FILTER (label = 'fuzzy') AS fuzzy_matches, (SELECT count(*) FROM ca WHERE verdict = 'torn') AS ambiguous_matches, (SELECT count(*) FROM ca WHERE verdict = 'new') AS true_additions,
            (SELECT count(*) FROM cev WHERE event_type = 'removed_project') AS true_removals_or_missing, 0::BIGINT AS true_withdrawals, 0::BIGINT AS true_completed, 0::BIGINT AS reclassifications
            FROM (SELECT CASE WHEN same_id THEN 'id' WHEN score >= 0.76 THEN 'fuzzy' ELSE 'possible' END AS label FROM ca WHERE verdict = 'linked')""",
        "voted_dates": "SELECT o_orderkey, o_orderdate::DATE AS asked, o_orderdate::DATE + 30 AS due FROM orders",
        "source_change_events": f"""WITH {_CAPTURES} SELECT watch_source_id, captured_at, CASE WHEN user_id % 4 = 0 THEN 'flexibility_rule' ELSE 'regulatory' END AS event_domain,
            CASE parse_status WHEN 'failed' THEN 'source_parse_failed' WHEN 'unchanged' THEN 'source_unchanged' ELSE CASE WHEN review THEN 'rule_needs_review' ELSE 'rule_source_changed' END END AS event_type, parse_status, content_hash, previous_content_hash,
            array_to_string(kw, ',') AS keywords, CASE parse_status WHEN 'failed' THEN 0.4 ELSE 0.9 END::DOUBLE AS confidence, parse_status = 'failed' AS is_ambiguous, parse_status = 'changed' AS is_hard_alert FROM st""",
        "latest_hashes": f"WITH {_CAPTURES} SELECT watch_source_id, arg_max(content_hash, captured_at) AS last_content_hash, max(captured_at) AS last_captured_at FROM hashed WHERE content_hash IS NOT NULL GROUP BY 1",
        "monthly_event_counts": "SELECT ts::DATE AS day, event_type, count(*) AS events, round(sum(value), 2) AS value FROM events GROUP BY ALL",
        "compute_costs": scn(f"SELECT scenario_id, round({_COST}, 2) AS annual_curtailed_mwh, round(({_COST}) * 1000.0 / 0.7, 1) AS gpu_hours_impacted, round({_USD}, 1) AS estimated_compute_cost_usd, depth > 25 OR hours > 3 AS is_extrapolated FROM scn"),
        "eligibility_matrix": scn("SELECT scenario_id, rule_id, rule_status, eligibility_status, CASE WHEN eligibility_status IN ('not_eligible', 'eligible') THEN 'Medium' ELSE 'Low' END AS eligibility_confidence, missing, mismatched FROM el", _eligible("scn", "scenario_id")),
        "eligibility_by_udtf": scn("SELECT scenario_id, rule_id, rule_status, eligibility_status, CASE WHEN eligibility_status IN ('not_eligible', 'eligible') THEN 'Medium' ELSE 'Low' END AS eligibility_confidence, missing, mismatched FROM el", _eligible("scn", "scenario_id")),
        "tradeoff_sweep": rated(f"SELECT scenario_id, depth AS commitment_depth_pct, eligibility_status, benefit_status, base AS baseline_timeline_days, days AS estimated_timeline_delta_days, round(base - days, 2) AS with_flex_timeline_days, {net} AS net_benefit_score FROM be", swept),
        "tradeoff_recommendation": rated("SELECT scenario_id, CASE WHEN count(net) > 0 THEN 'max_net_benefit_under_assumptions' ELSE 'scenario_comparison_only' END AS mode, arg_max(depth, (net, -depth)) FILTER (net IS NOT NULL) AS commitment_depth_pct, max(net) AS net_benefit_score FROM q GROUP BY 1", f"{swept}, q AS (SELECT scenario_id, depth, {net} AS net FROM be)"),
        "lead_time_conflicts": f"WITH {_LEAD} SELECT lead_time_id, equipment_class, is_stale, count(DISTINCT (low, high)) OVER (PARTITION BY equipment_class, band) > 1 AS conflict_flag FROM ld",
        "equipment_scopes": scn("SELECT scenario_id, position::INT AS position, equipment_class, 'scope_' || replace(replace(replace(lower(equipment_class), ' ', '_'), '/', ''), '-', '_') AS scope_item_id, CASE WHEN equipment_class IS NULL THEN 'insufficient_data' ELSE 'generated_planning_model' END AS scope_mode FROM scope", _SCOPE),
        "critical_paths": scn("SELECT * FROM path", path),
        "missing_classes": scn("SELECT DISTINCT equipment_class FROM scope WHERE equipment_class IS NOT NULL AND equipment_class NOT IN (SELECT equipment_class FROM ld)", path),
        "time_to_power": rated(
            f"""SELECT scenario_id, benefit_status, {', '.join(f'{v} AS {k}' for k, v in total.items())},
                CASE WHEN bl IS NULL THEN 'insufficient_interconnection_baseline' WHEN unsupported_flag THEN 'insufficient_procurement_data' WHEN conflict_flag THEN 'conflicting_procurement_data' WHEN stale_flag THEN 'stale_procurement_data' ELSE 'complete' END AS estimate_status,
                CASE WHEN benefit_status = 'quantified' THEN 'flex' ELSE 'no_flex' END || CASE strategy WHEN 2 THEN '_overlap' ELSE '_serial' END AS selected_case,
                CASE WHEN strategy = 2 THEN CASE WHEN coalesce(ph, 0) >= coalesce(bh, 0) THEN 'procurement' ELSE 'interconnection' END WHEN coalesce(bh, 0) >= coalesce(ph, 0) AND coalesce(bh, 0) >= 74 THEN 'interconnection' WHEN coalesce(ph, 0) >= 74 THEN 'procurement' ELSE 'commissioning_and_buffer' END AS binding_constraint,
                ['insufficient', 'low', 'medium', 'high'][least(list_position(['Insufficient', 'Low', 'Medium', 'High'], conf), list_position(['insufficient', 'low', 'medium', 'high'], procurement_confidence))] AS estimate_confidence FROM y""",
            estimates,
        ),
        "time_to_power_components": rated(" UNION ALL ".join(f"SELECT scenario_id, {i} AS position, '{k}' AS component_type, ({lo})::DOUBLE AS low_days, ({hi})::DOUBLE AS high_days, '{src}' AS source_type FROM y" for i, (k, lo, hi, src) in enumerate(parts)), estimates),
    }


