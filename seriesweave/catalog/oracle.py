"""Equivalent SQL for the queries, written against the test tables directly.

These follow the plain definitions (a window per series, a generated spine for
empty buckets) and share nothing with the DataFrame operators.
"""

from __future__ import annotations

from .fixtures import CHANGE, FIRST_DAY, RUN_TS

AVAILABLE = "NOT (state IS NULL OR trim(state) = '' OR lower(trim(state)) IN ('unavailable', 'unknown'))"
LEADING = r"coalesce(try_cast(regexp_extract(state, '^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)', 1) AS DOUBLE), 0.0)"
GRAINS = "(VALUES ('statistics', 3600), ('statistics_short_term', 300)) AS g(tbl, i)"


def fixture(by: str = "user") -> str:
    name = "'sensor.u' || user_id" if by == "user" else "'sensor.' || event_type"
    return f"""
readings AS (
  SELECT {name} || CASE WHEN ts < TIMESTAMP '{CHANGE}' THEN '_old' ELSE '_new' END AS series_id,
         user_id, event_id AS row_id, event_type, strftime(ts, '%Y-%m-%d') AS day,
         epoch_us(ts) / 1e6 AS ts, CAST(round(value * 100) AS BIGINT) AS cents,
         (epoch_us(ts) // 1000000 % 86400) * 10 + CAST(round(value * 100) AS BIGINT) AS counter
  FROM events),
marked AS (SELECT *, event_type = 'signup' AND cents % 10 = 0 AS with_unit FROM readings),
states AS (
  SELECT series_id, ts, row_id,
         CASE WHEN event_type = 'error'
              THEN CASE row_id % 4 WHEN 0 THEN 'unavailable' WHEN 2 THEN '' WHEN 3 THEN ' Unknown ' END
              WHEN with_unit THEN counter || ' kWh' ELSE CAST(counter AS VARCHAR) END AS state,
         CASE WHEN event_type <> 'view' THEN '{{"last_reset":"' || day || 'T00:00:00+00:00"}}' END AS attrs,
         CASE WHEN event_type <> 'view' THEN day || 'T00:00:00+00:00' END AS reset
  FROM marked),
folded AS (
  SELECT series_id, tbl, CAST(i AS BIGINT) AS i, CAST(trunc(ts / i) AS BIGINT) * i AS start, min(row_id) AS row_id, max(row_id) AS last_row,
         arg_max(v, ts) AS state, avg(v) AS mean, min(v) AS mn, max(v) AS mx
  FROM (SELECT *, CASE WHEN event_type <> 'error' AND NOT with_unit THEN CAST(counter AS DOUBLE) END AS v FROM marked),
       {GRAINS}
  GROUP BY series_id, tbl, i, CAST(trunc(ts / i) AS BIGINT) * i),
stats AS (
  SELECT series_id, tbl, i, CAST(start AS DOUBLE) AS start_ts, row_id, state,
         floor((start - {FIRST_DAY}) / 10) + mx AS sum, mean, mn, mx, CAST(NULL AS VARCHAR) AS last_reset,
         CASE WHEN last_row % 3 <> 0 THEN CAST(start - start % 86400 AS DOUBLE) END AS last_reset_ts,
         CAST(start + i AS DOUBLE) AS created_ts
  FROM folded)"""


def pairs(kind: str | None = "total_increasing", from_zero: bool = False, by: str = "user") -> str:
    col, name = ("user_id", "'sensor.u' || user_id") if by == "user" else ("event_type", "'sensor.' || event_type")
    label = (
        f"'{kind}'"
        if kind
        else "CASE user_id % 3 WHEN 0 THEN 'total_increasing' WHEN 1 THEN 'total' ELSE 'measurement' END"
    )
    return f"""
pairs AS (
  SELECT {name} || '_old' AS old_id, {name} || '_new' AS new_id, {label} AS kind, {str(from_zero).lower()} AS zero
  FROM events GROUP BY {col}
  HAVING min(ts) < TIMESTAMP '{CHANGE}' AND max(ts) >= TIMESTAMP '{CHANGE}')"""


CLASSES = """
classes AS (
  SELECT 'sensor.u' || user_id || half AS series_id,
         CASE WHEN half = '_new' AND user_id % 10 = 7 THEN 'measurement'
              WHEN user_id % 3 = 0 THEN 'total_increasing' WHEN user_id % 3 = 1 THEN 'total' ELSE 'measurement' END
           AS state_class
  FROM (SELECT DISTINCT user_id FROM events), (VALUES ('_old'), ('_new')) AS h(half))"""

STAT_COLUMNS = (
    'series_id, tbl AS "table", i AS interval_s, start_ts, row_id, state, sum, mean, mn AS min, mx AS max, '
    "last_reset, last_reset_ts, created_ts"
)


def generation(
    kind: str | None, tables: str = "both", from_zero: bool = False, by: str = "user", marks: str = "epoch"
) -> str:
    """Common table expressions ending in ``generated`` (columns as in ``stats``)."""
    grains = {
        "both": GRAINS,
        "hourly": "(VALUES ('statistics', 3600)) AS g(tbl, i)",
        "short": "(VALUES ('statistics_short_term', 300)) AS g(tbl, i)",
    }[tables]
    epoch = "epoch(try_cast(replace(substr(reset, 1, 19), 'T', ' ') AS TIMESTAMP))"
    return f"""{fixture(by)},{pairs(kind, from_zero, by)},
usable AS (
  SELECT s.series_id, p.kind, p.zero, s.ts, s.row_id, {LEADING} AS v,
         CASE WHEN p.kind = 'total' THEN s.reset END AS reset
  FROM states s JOIN pairs p ON p.new_id = s.series_id WHERE {AVAILABLE}),
lagged AS (
  SELECT *, lag(v) OVER w AS pv, lag(reset) OVER w AS pr FROM usable
  WINDOW w AS (PARTITION BY series_id ORDER BY ts, row_id)),
deltas AS (
  SELECT *, CASE WHEN pv IS NULL THEN CASE WHEN zero AND kind <> 'measurement' THEN v ELSE 0.0 END
                 WHEN kind = 'total' AND reset <> pr THEN greatest(v, 0.0)
                 WHEN v < pv THEN 0.0 ELSE v - pv END AS dv FROM lagged),
running AS (
  SELECT *, sum(dv) OVER (PARTITION BY series_id ORDER BY ts, row_id ROWS UNBOUNDED PRECEDING) AS run FROM deltas),
grain AS (SELECT tbl, CAST(i AS BIGINT) AS i FROM {grains}),
buckets AS (
  SELECT series_id, kind, tbl, i, CAST(trunc(ts / i) AS BIGINT) * i AS start,
         arg_max(v, row_id) AS state, arg_max(run, row_id) AS run, min(v) AS mn, max(v) AS mx, avg(v) AS mean,
         max_by(struct_pack(r := reset), row_id).r AS reset
  FROM running, grain GROUP BY series_id, kind, tbl, i, CAST(trunc(ts / i) AS BIGINT) * i),
spine AS (
  SELECT series_id, kind, tbl, i, unnest(generate_series(lo, greatest(lo, hi - i), i)) AS start
  FROM (SELECT series_id, kind, tbl, i, min(start) AS lo, max(start) AS hi FROM buckets GROUP BY ALL)),
filled AS (
  SELECT p.series_id, p.kind, p.tbl, p.i, p.start,
         last_value(b.state IGNORE NULLS) OVER w AS state, last_value(b.run IGNORE NULLS) OVER w AS run,
         last_value(b.mn IGNORE NULLS) OVER w AS mn, last_value(b.mx IGNORE NULLS) OVER w AS mx,
         last_value(b.mean IGNORE NULLS) OVER w AS mean, last_value(b.reset IGNORE NULLS) OVER w AS reset
  FROM spine p LEFT JOIN buckets b USING (series_id, tbl, start)
  WINDOW w AS (PARTITION BY p.series_id, p.tbl ORDER BY p.start ROWS UNBOUNDED PRECEDING)),
base AS (
  SELECT p.new_id AS series_id, tbl, arg_max(sum, start_ts) AS base
  FROM stats s JOIN pairs p ON p.old_id = s.series_id WHERE sum IS NOT NULL GROUP BY ALL),
copied AS (
  SELECT p.new_id AS series_id, s.* EXCLUDE (series_id, last_reset, last_reset_ts),
         {"CAST(NULL AS VARCHAR) AS last_reset, last_reset_ts" if marks == "epoch" else "last_reset, CAST(NULL AS DOUBLE) AS last_reset_ts"}
  FROM stats s JOIN pairs p ON p.old_id = s.series_id WHERE s.tbl IN (SELECT tbl FROM grain)),
generated AS (
  SELECT series_id, tbl, i, start_ts, row_id, state, sum, mean, mn, mx, last_reset, last_reset_ts, created_ts FROM copied
  UNION ALL
  SELECT f.series_id, f.tbl, f.i, CAST(f.start AS DOUBLE), NULL, f.state,
         CASE WHEN kind <> 'measurement' THEN coalesce(base, 0.0) + run END,
         CASE WHEN kind = 'measurement' THEN mean END, CASE WHEN kind = 'measurement' THEN mn END,
         CASE WHEN kind = 'measurement' THEN mx END,
         {"NULL" if marks == "epoch" else "CASE WHEN kind = 'total' THEN reset END"},
         {f"CASE WHEN kind = 'total' THEN {epoch} END" if marks == "epoch" else "NULL"}, CAST({RUN_TS} AS DOUBLE)
  FROM filled f LEFT JOIN base USING (series_id, tbl))"""


def gaps(rows: str) -> str:
    return f"""
SELECT series_id, tbl AS "table", pts AS before_ts, start_ts AS after_ts,
       CAST(round_even((start_ts - pts) / i, 0) AS BIGINT) - 1 AS missing,
       pstate AS before_state, psum AS before_sum, state AS after_state, sum AS after_sum
FROM (SELECT *, lag(start_ts) OVER w AS pts, lag(state) OVER w AS pstate, lag(sum) OVER w AS psum FROM {rows}
      WINDOW w AS (PARTITION BY series_id, tbl ORDER BY start_ts NULLS FIRST, row_id NULLS FIRST))
WHERE start_ts - pts > 1.5 * i"""


def ends(value: str, total: str | None, time: str, rows: str, unavailable: str, keys: str) -> str:
    cols = [("ts", time), ("value", value)] + ([("sum", total)] if total else [])
    parts = []
    for name, pick, condition in (
        ("earliest", "arg_min", "TRUE"),
        ("latest", "arg_max", "TRUE"),
        ("earliest_available", "arg_min", f"NOT {unavailable}"),
        ("latest_available", "arg_max", f"NOT {unavailable}"),
    ):
        for field, expr in cols:
            parts.append(
                f"({pick}(struct_pack(x := {expr}), {time}) FILTER (WHERE {condition})).x AS {name}_{field}"
            )
    return f"""SELECT {keys}, count(*) AS row_count, count(*) FILTER (WHERE {unavailable}) AS unavailable_count,
       {', '.join(parts)} FROM {rows} GROUP BY ALL"""


STATE_ENDS = ends("state", None, "ts", "states", f"(NOT ({AVAILABLE}))", "series_id")
NO_VALUE = "(coalesce(state, sum, mean, mn, mx) IS NULL)"
STAT_ENDS = ends("coalesce(state, mean, mn, mx)", "sum", "start_ts", "stats", NO_VALUE, 'series_id, tbl AS "table"')

SUMMARY_ALL = f"""
state_ends AS ({STATE_ENDS}), stat_ends AS ({STAT_ENDS}),
both_ends AS (
  SELECT series_id, 'states' AS "table", row_count, unavailable_count,
         {', '.join(f"{e}_ts, {e}_value, CAST(NULL AS DOUBLE) AS {e}_sum" for e in ("earliest", "latest", "earliest_available", "latest_available"))}
  FROM state_ends
  UNION ALL
  SELECT series_id, "table", row_count, unavailable_count,
         {', '.join(f"{e}_ts, CAST({e}_value AS VARCHAR), CASE WHEN {e}_value IS NOT NULL THEN {e}_sum END" for e in ("earliest", "latest", "earliest_available", "latest_available"))}
  FROM stat_ends),
summary AS (
  SELECT *, (earliest_available_ts IS NOT DISTINCT FROM earliest_ts
             AND earliest_available_value IS NOT DISTINCT FROM earliest_value
             AND earliest_available_sum IS NOT DISTINCT FROM earliest_sum) AS same_first,
            (latest_available_ts IS NOT DISTINCT FROM latest_ts
             AND latest_available_value IS NOT DISTINCT FROM latest_value
             AND latest_available_sum IS NOT DISTINCT FROM latest_sum) AS same_last
  FROM both_ends)"""

STATE_RUNS = f"""
state_flags AS (SELECT series_id, ts, row_id, state, NOT ({AVAILABLE}) AS un FROM states),
state_steps AS (
  SELECT *, CASE WHEN lag(un) OVER w IS NOT DISTINCT FROM un AND lag(state) OVER w IS NOT DISTINCT FROM state
                 AND lag(row_id) OVER w IS NOT NULL THEN 0 ELSE 1 END AS step
  FROM state_flags WINDOW w AS (PARTITION BY series_id ORDER BY ts, row_id)),
state_groups AS (
  SELECT *, sum(step) OVER (PARTITION BY series_id ORDER BY ts, row_id) AS grp FROM state_steps),
state_runs AS (
  SELECT series_id, 'states' AS "table", min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS row_count,
         coalesce(state, 'NULL') AS value
  FROM state_groups WHERE un GROUP BY series_id, grp, state)"""
STAT_RUNS = f"""
stat_groups AS (
  SELECT *, sum(CASE WHEN {NO_VALUE} THEN 0 ELSE 1 END) OVER (PARTITION BY series_id, tbl ORDER BY start_ts, row_id) AS grp FROM stats),
stat_runs AS (
  SELECT series_id, tbl AS "table", min(start_ts) AS start_ts, max(start_ts) AS end_ts, count(*) AS row_count, 'NULL' AS value
  FROM stat_groups WHERE {NO_VALUE} GROUP BY series_id, tbl, grp)"""


def numeric_states(where: str = "TRUE") -> str:
    return f"""
numeric AS (
  SELECT s.*, try_cast(state AS DOUBLE) AS v, epoch(try_cast(replace(substr(reset, 1, 19), 'T', ' ') AS TIMESTAMP)) AS mark
  FROM states s WHERE {AVAILABLE} AND try_cast(state AS DOUBLE) IS NOT NULL AND {where}),
numeric_lag AS (
  SELECT *, lag(ts) OVER w AS pts, lag(state) OVER w AS pstate, lag(v) OVER w AS pv,
         last_value(mark IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts, row_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pmark
  FROM numeric WINDOW w AS (PARTITION BY series_id ORDER BY ts, row_id))"""


def valued(rows: str) -> str:
    return f"""
valued AS (
  SELECT series_id, tbl, start_ts AS ts, row_id, coalesce(state, sum, mean, mn, mx) AS v, last_reset_ts AS mark
  FROM {rows} WHERE NOT {NO_VALUE}),
valued_lag AS (
  SELECT *, lag(ts) OVER w AS pts, lag(v) OVER w AS pv,
         last_value(mark IGNORE NULLS) OVER (PARTITION BY series_id, tbl ORDER BY ts, row_id NULLS FIRST
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pmark
  FROM valued WINDOW w AS (PARTITION BY series_id, tbl ORDER BY ts, row_id NULLS FIRST))"""


def state_events(condition: str, mark: str = "") -> str:
    return f"""SELECT series_id, 'states' AS "table", ts AS event_ts, {mark} pts AS before_ts, pstate AS before_value,
       ts AS after_ts, state AS after_value FROM numeric_lag WHERE {condition}"""


def stat_events(condition: str) -> str:
    return f"""SELECT series_id, tbl AS "table", ts AS event_ts, mark AS last_reset_ts, pts AS before_ts,
       CAST(pv AS VARCHAR) AS before_value, ts AS after_ts, CAST(v AS VARCHAR) AS after_value
FROM valued_lag WHERE {condition}"""


MARKED_AGAIN = "mark <> pmark"
FELL = "v < 0.9 * pv"

VALUES = (("state", "state"), ("sum", "sum"), ("mean", "mean"), ("min", "mn"), ("max", "mx"))


def changes(before: str, after: str, name: str = "changes", extra: str = "") -> str:
    """Common table expressions ending in ``name``: the flat change report."""
    cols = [c for _, c in VALUES] + ["last_reset_ts", "created_ts"]
    differs = {
        c: (
            f"CAST(trunc(b.{c}) AS BIGINT) IS DISTINCT FROM CAST(trunc(a.{c}) AS BIGINT)"
            if c.endswith("_ts")
            else f"b.{c} IS DISTINCT FROM a.{c}"
        )
        for c in cols
    }
    out = []
    for label, c in (*VALUES, ("last_reset_ts", "last_reset_ts"), ("created_ts", "created_ts")):
        out += [f"CASE WHEN {differs[c]} THEN b.{c} END AS {label}_old", f"CASE WHEN {differs[c]} THEN a.{c} END AS {label}_new"]
        if not c.endswith("_ts"):
            out.append(f"CASE WHEN {differs[c]} THEN a.{c} - b.{c} END AS {label}_delta")
    flags = [f"({differs[c]}) AS d_{label}" for label, c in (*VALUES, ("last_reset_ts", "last_reset_ts"), ("created_ts", "created_ts"))]
    pick = lambda rows: f"""(SELECT * FROM {rows} WHERE start_ts IS NOT NULL
       QUALIFY row_number() OVER (PARTITION BY series_id, tbl, start_ts ORDER BY row_id DESC NULLS LAST) = 1)"""
    return f"""
{name}_raw AS (
  SELECT coalesce(b.series_id, a.series_id) AS series_id, coalesce(b.tbl, a.tbl) AS tbl, coalesce(b.i, a.i) AS i,
         coalesce(b.start_ts, a.start_ts) AS start_ts, {', '.join(out)}, {', '.join(flags)}
  FROM {pick(before)} b FULL OUTER JOIN {pick(after)} a USING (series_id, tbl, start_ts)),
{name} AS (SELECT * FROM {name}_raw WHERE {' OR '.join(f'd_{x}' for x in (*[v[0] for v in VALUES], 'last_reset_ts', 'created_ts'))})"""


FLAT_CHANGES = ", ".join(
    ['series_id, tbl AS "table", start_ts']
    + [f"{c}_{s}" for c, _ in VALUES for s in ("old", "new", "delta")]
    + [f"{c}_{s}" for c in ("last_reset_ts", "created_ts") for s in ("old", "new")]
)

EDITED = f"""
edited AS (
  SELECT * REPLACE (CASE WHEN last_reset_ts IS NULL THEN start_ts + i * 1000 ELSE start_ts END AS start_ts,
                    CASE WHEN state < 200000 THEN state + 1.5 ELSE state END AS state, sum + 10 AS sum,
                    CASE WHEN state > 600000 THEN last_reset_ts + 0.25 ELSE last_reset_ts END AS last_reset_ts,
                    CAST({RUN_TS} AS DOUBLE) AS created_ts)
  FROM stats WHERE NOT {NO_VALUE})"""

# Edited in some series only.
EDITED_FEW = """
edited_few AS (
  SELECT * FROM edited WHERE contains(series_id, '1_')
  UNION ALL BY NAME SELECT * FROM stats WHERE NOT contains(series_id, '1_'))"""


def condensed(rows: str) -> str:
    return f"""
blocks AS (
  SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY series_id, tbl ORDER BY start_ts) AS block
  FROM (SELECT *, coalesce(start_ts - lag(start_ts) OVER (PARTITION BY series_id, tbl ORDER BY start_ts) = i, FALSE) AS joined
        FROM {rows})),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY series_id, tbl, block ORDER BY start_ts) AS idx,
         count(*) OVER (PARTITION BY series_id, tbl, block) AS n FROM blocks),
kept AS (
  SELECT * FROM placed
  WHERE idx <= 3 OR idx > n - 3 OR d_state OR d_mean OR d_min OR d_max OR d_last_reset_ts),
condensed AS (
  SELECT *, coalesce(idx - lag(idx) OVER (PARTITION BY series_id, tbl, block ORDER BY idx) > 1, FALSE) AS omitted_before FROM kept)"""


def planned(kind: str | None = None) -> str:
    return f"""{generation(kind, from_zero=True)},
cut AS (SELECT p.new_id AS series_id, tbl, max(start_ts) AS cut FROM stats s JOIN pairs p ON p.old_id = s.series_id GROUP BY ALL),
current_rows AS (
  SELECT s.* FROM stats s JOIN pairs p ON p.new_id = s.series_id LEFT JOIN cut c ON c.series_id = s.series_id AND c.tbl = s.tbl
  WHERE cut IS NULL OR start_ts > cut),
later_rows AS (
  SELECT g.* FROM generated g LEFT JOIN cut c ON c.series_id = g.series_id AND c.tbl = g.tbl WHERE cut IS NULL OR start_ts > cut)"""


GENERATED = f"SELECT {STAT_COLUMNS} FROM generated"
ALL_KINDS = generation(None, from_zero=True)
#: The statistics as they are stored: reset marks as text, no values but state and sum.
STORED = """
stored AS (
  SELECT series_id, tbl, i, start_ts, row_id, state, sum, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS mn, CAST(NULL AS DOUBLE) AS mx,
         strftime(make_timestamp(CAST(last_reset_ts AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS last_reset,
         CAST(NULL AS DOUBLE) AS last_reset_ts, CAST(NULL AS DOUBLE) AS created_ts FROM stats)"""


def from_stored(kind: str | None) -> str:
    """``generation`` of both tables from ``stored``."""
    made = generation(kind, "both", True, marks="text").replace("\nusable AS (", f"{STORED},\nusable AS (")
    made = made.replace("FROM stats s JOIN", "FROM stored s JOIN")
    epoch = "epoch(try_cast(replace(substr(last_reset, 1, 19), 'T', ' ') AS TIMESTAMP))"  # copied rows derive it from the text
    return made.replace("last_reset, CAST(NULL AS DOUBLE) AS last_reset_ts\n  FROM stored", f"last_reset, {epoch} AS last_reset_ts\n  FROM stored")



REGISTRY = """
docs AS (
  SELECT c_custkey AS k, c_custkey % 50 AS m, lower(c_mktsegment) AS platform, CAST(c_nationkey AS BIGINT) AS nation FROM customer),
good AS (SELECT * FROM docs WHERE m NOT IN (17, 18, 19)),
halves AS (SELECT *, 'sensor.c' || k || '_' || half AS entity_id FROM good, (VALUES ('old'), ('new')) AS h(half))"""


def attribute_rows() -> str:
    """(path, old, new) of the registry fixture; the word null stands for a null value."""
    area = "CASE WHEN nation % 3 <> 0 THEN 'area' || nation ELSE 'null' END"
    rows = [
        ("entity_id", "'sensor.c' || k || '_old'", "'sensor.c' || k || '_new'"),
        ("unique_id", "'u' || k", "'u' || k"),
        ("platform", "platform", "platform"),
        ("area_id", area, area),
        ("name", "'meter'", "'Meter'"),
        (
            "capabilities/state_class",
            "CASE WHEN k % 5 <> 0 THEN 'total_increasing' ELSE 'null' END",
            "CASE WHEN k % 5 <> 0 THEN 'measurement' ELSE 'null' END",
        ),
        ("original_state_class", "'total'", "'total'"),
        ("options/a", "CAST(nation AS VARCHAR)", "CAST(nation AS VARCHAR)"),
        ("options/b", "CAST(nation AS VARCHAR)", "CAST(nation + k % 2 AS VARCHAR)"),
        ("aliases", "'[\"a\",\"' || k || '\"]'", "'[\"a\"]'"),
        ("has_entity_name", "'true'", "CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END"),
    ]
    rank = {"entity_id": 1, "unique_id": 3, "platform": 4, "area_id": 8, "name": 9, "has_entity_name": 16}
    return " UNION ALL ".join(
        f"SELECT k, '{p}' AS path, {o} AS old_value, {n} AS new_value, {rank.get(p, 10000)} AS rank FROM good" for p, o, n in rows
    )


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


def _time(x: str) -> str:
    return f"strftime(make_timestamp(CAST(floor({x}) AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S')"


def _summary_cells() -> str:
    """The summary as (series_id, path, value) rows."""
    cells = [(c, f"CAST({c} AS VARCHAR)", "TRUE") for c in ("row_count", "unavailable_count")]
    for e, shown in (
        ("earliest", "TRUE"),
        ("latest", "TRUE"),
        ("earliest_available", "NOT same_first"),
        ("latest_available", "NOT same_last"),
    ):
        with_sum = f"{e}_value || ' (' || CAST({e}_sum AS VARCHAR) || ')'"
        cells.append((f"{e}/ts", _time(f"{e}_ts"), shown))
        cells.append((f"{e}/value", f"CASE WHEN {e}_sum IS NULL THEN {e}_value ELSE {with_sum} END", shown))
    selects = " UNION ALL ".join(
        f"SELECT series_id, \"table\" || '/{path}' AS path, {value} AS value FROM summary WHERE {shown}"
        for path, value, shown in cells
    )
    return f"cells AS ({selects})"


ELIGIBLE = f"""
avail AS (SELECT * FROM states WHERE {AVAILABLE}),
facts AS (
  SELECT p.old_id, p.new_id, co.state_class AS kind, cn.state_class AS new_kind,
         (SELECT max(ts) FROM avail a WHERE a.series_id = p.old_id) AS old_end,
         (SELECT min(ts) FROM avail a WHERE a.series_id = p.new_id) AS new_start,
         (SELECT max(start_ts) FROM stats a WHERE a.series_id = p.old_id) AS send
  FROM pairs p LEFT JOIN classes co ON co.series_id = p.old_id LEFT JOIN classes cn ON cn.series_id = p.new_id),
reasons AS (
  SELECT *, CASE WHEN kind IS DISTINCT FROM new_kind OR kind IS NULL THEN 'classes differ or are not supported'
       WHEN old_end IS NULL OR new_start IS NULL THEN 'no available states'
       WHEN floor(new_start) <= floor(old_end) THEN 'new states start before old states end' END AS reason FROM facts),
eligible AS (SELECT * FROM reasons WHERE reason IS NULL)"""


def _change(c: str) -> str:
    """The text of a changed value; the changed values end in .0 or .5."""
    number = f"regexp_replace(regexp_replace(printf('%.6f', abs({c}_delta)), '0+$', ''), '\\.$', '')"
    return (
        f"CASE WHEN d_{c} THEN coalesce(CAST({c}_old AS VARCHAR), '(none)') || ' -> ' || coalesce(CAST({c}_new AS VARCHAR), '(none)')"
        f" || CASE WHEN {c}_delta IS NULL THEN '' ELSE ' (' || CASE WHEN {c}_delta >= 0 THEN '+' ELSE '-' END || {number} || ')' END"
        " ELSE '' END"
    )


F = fixture()
_TEXT = "coalesce(CAST({0} AS VARCHAR), 'NULL')"

ORACLE: dict[str, str] = {
    "missing_rows_hourly": _with(F) + gaps("(SELECT * FROM stats WHERE tbl = 'statistics')"),
    "missing_rows_short": _with(F) + gaps("(SELECT * FROM stats WHERE tbl = 'statistics_short_term')"),
    "missing_rows_dense": _with(fixture("type")) + gaps("stats"),
    "missing_rows_text": _with(F, f" g AS ({gaps('(SELECT * FROM stats WHERE tbl = $$statistics$$)')})")
    + f""" SELECT series_id, before_ts, {_time('before_ts')} || ' - ' || {_time('after_ts')} || ' [' || missing || ' rows]' || chr(10)
       || {_TEXT.format('before_state')} || '/' || {_TEXT.format('before_sum')} || ' - '
       || {_TEXT.format('after_state')} || '/' || {_TEXT.format('after_sum')} AS gap FROM g""",
    "state_summary": _with(F) + STATE_ENDS,
    "statistics_summary": _with(F) + STAT_ENDS,
    "summary_all": _with(F, SUMMARY_ALL)
    + "SELECT series_id, \"table\", row_count, unavailable_count, earliest_ts, earliest_value, earliest_sum, latest_ts, latest_value, latest_sum, "
    + ", ".join(f"CASE WHEN NOT same_first THEN earliest_available_{f} END AS earliest_available_{f}" for f in ("ts", "value", "sum"))
    + ", "
    + ", ".join(f"CASE WHEN NOT same_last THEN latest_available_{f} END AS latest_available_{f}" for f in ("ts", "value", "sum"))
    + " FROM summary",
    "summary_diff": _with(F, pairs(), SUMMARY_ALL, _summary_cells())
    + """, o AS MATERIALIZED (SELECT old_id, new_id, path, value FROM cells JOIN pairs ON series_id = old_id),
n AS MATERIALIZED (SELECT old_id, new_id, path, value FROM cells JOIN pairs ON series_id = new_id)
SELECT old_id, new_id, path, CASE WHEN o.p IS NOT NULL THEN coalesce(o.value, 'null') END AS old_value,
       CASE WHEN n.p IS NOT NULL THEN coalesce(n.value, 'null') END AS new_value,
       CASE WHEN n.p IS NULL THEN 'only_old' WHEN o.p IS NULL THEN 'only_new'
            WHEN o.value IS NOT DISTINCT FROM n.value THEN 'same' ELSE 'different' END AS diff
FROM (SELECT *, path AS p FROM o) o FULL OUTER JOIN (SELECT *, path AS p FROM n) n USING (old_id, new_id, path)
WHERE n.p IS NULL OR o.p IS NULL OR o.value IS NOT NULL OR n.value IS NOT NULL""",
    "state_outage_runs": _with(F, STATE_RUNS) + "SELECT * FROM state_runs",
    "state_outage_runs_dense": _with(fixture("type"), STATE_RUNS) + "SELECT * FROM state_runs",
    "statistics_outage_runs": _with(F, STAT_RUNS) + "SELECT * FROM stat_runs",
    "outage_report": _with(F, STATE_RUNS, STAT_RUNS)
    + f"""SELECT series_id, "table", start_ts,
       CASE WHEN row_count <= 1 THEN {_time('start_ts')} ELSE {_time('start_ts')} || ' - ' || {_time('end_ts')} END AS "when",
       value, row_count FROM (SELECT * FROM state_runs UNION ALL SELECT * FROM stat_runs)""",
    "earliest_state": _with(F) + "SELECT series_id, min(ts) AS ts FROM states GROUP BY series_id",
    "latest_statistics": _with(F) + 'SELECT series_id, tbl AS "table", max(start_ts) AS ts FROM stats GROUP BY ALL',
    "last_reset_rows": _with(F)
    + 'SELECT series_id, tbl AS "table", start_ts, last_reset_ts FROM stats WHERE last_reset_ts IS NOT NULL',
    "last_reset_rows_text": _with(F)
    + """SELECT series_id, tbl AS "table", start_ts,
       strftime(make_timestamp(CAST(last_reset_ts AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS last_reset
FROM stats WHERE tbl = 'statistics' AND last_reset_ts IS NOT NULL""",
    "last_reset_rows_text_both": _with(F, STORED)
    + 'SELECT series_id, tbl AS "table", start_ts, last_reset FROM stored WHERE last_reset IS NOT NULL',
    "last_reset_rows_two_ages": _with(F, STORED)
    + """SELECT s.series_id, s.tbl AS "table", s.start_ts, CASE WHEN newer THEN s.last_reset_ts END AS last_reset_ts,
       CASE WHEN NOT newer THEN t.last_reset END AS last_reset
FROM (SELECT *, CAST(regexp_extract(series_id, 'u([0-9]+)_', 1) AS BIGINT) % 2 = 0 AS newer FROM stats WHERE last_reset_ts IS NOT NULL) s
JOIN stored t USING (series_id, tbl, start_ts)""",
    "statistics_resets_two_ages": _with(F, valued("stats")) + stat_events(MARKED_AGAIN),
    "state_resets_increasing": _with(F, numeric_states()) + state_events(FELL),
    "state_resets_dense": _with(fixture("type"), numeric_states()) + state_events(FELL),
    "state_resets_total": _with(F, numeric_states()) + state_events(MARKED_AGAIN, "mark AS last_reset_ts,"),
    "statistics_resets_increasing": _with(F, valued("stats")) + stat_events(FELL),
    "statistics_resets_total": _with(F, valued("stats")) + stat_events(MARKED_AGAIN),
    "statistics_resets_text": _with(F, valued("stats")) + stat_events(MARKED_AGAIN),
    "statistics_resets_any_fall": _with(F, valued("stats")) + stat_events("v < pv"),
    "reset_report": _with(F, CLASSES, numeric_states(), valued("stats"))
    + f""", events_of_states AS (
  SELECT e.series_id, 'states' AS "table", ts AS event_ts, CASE WHEN state_class = 'total' THEN mark END AS last_reset_ts,
         pts, pstate AS before, ts, state AS after
  FROM numeric_lag e JOIN classes c USING (series_id)
  WHERE (state_class = 'total' AND {MARKED_AGAIN}) OR (state_class = 'total_increasing' AND {FELL})),
events_of_stats AS (
  SELECT e.series_id, tbl AS "table", ts AS event_ts, mark AS last_reset_ts, pts, CAST(pv AS VARCHAR) AS before, ts, CAST(v AS VARCHAR) AS after
  FROM valued_lag e JOIN classes c USING (series_id)
  WHERE (state_class = 'total' AND {MARKED_AGAIN}) OR (state_class = 'total_increasing' AND {FELL})),
everything AS (
  SELECT r.report, e.* FROM events_of_states e, (VALUES ('statistics'), ('statistics_short_term')) AS r(report)
  UNION ALL SELECT "table", e.* FROM events_of_stats e)
SELECT report, series_id, "table", event_ts, last_reset_ts,
       {_time('pts')} || ' - ' || {_time('ts')} || chr(10) || before || ' - ' || after AS range FROM everything""",
    "generate_increasing_hourly": _with(generation("total_increasing", "hourly")) + GENERATED,
    "generate_increasing_short": _with(generation("total_increasing", "short")) + GENERATED,
    "generate_increasing_from_zero": _with(generation("total_increasing", "hourly", True)) + GENERATED,
    "generate_increasing_dense": _with(generation("total_increasing", "both", by="type")) + GENERATED,
    "generate_total_hourly": _with(generation("total", "hourly", True)) + GENERATED,
    "generate_total_text_marks": _with(generation("total", "hourly", True, marks="text")) + GENERATED,
    "generate_measurement_hourly": _with(generation("measurement", "hourly")) + GENERATED,
    "generate_all_kinds": _with(ALL_KINDS) + GENERATED,
    "copied_statistics": _with(generation("total_increasing")) + f"SELECT {STAT_COLUMNS} FROM copied",
    "generated_gaps": _with(ALL_KINDS) + gaps("generated"),
    "generated_resets": _with(ALL_KINDS, valued("generated"))
    + stat_events(
        f"((SELECT kind FROM pairs WHERE new_id = series_id) = 'total' AND {MARKED_AGAIN}) "
        f"OR ((SELECT kind FROM pairs WHERE new_id = series_id) = 'total_increasing' AND {FELL})"
    ),
    "generated_counts_by_table": _with(ALL_KINDS)
    + 'SELECT series_id, tbl AS "table", count(*) AS row_count FROM generated GROUP BY ALL',
    "generated_preview": _with(ALL_KINDS)
    + """, cut AS (SELECT p.new_id AS series_id, tbl, max(start_ts) AS cut FROM stats s JOIN pairs p ON p.old_id = s.series_id GROUP BY ALL),
g AS (SELECT g.*, cut FROM generated g JOIN cut USING (series_id, tbl)),
before AS (SELECT * FROM g WHERE start_ts <= cut QUALIFY row_number() OVER (PARTITION BY series_id, tbl ORDER BY start_ts DESC, state DESC NULLS LAST, sum DESC NULLS LAST) = 1),
later AS (SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY series_id, tbl) AS n FROM g WHERE start_ts > cut
          WINDOW w AS (PARTITION BY series_id, tbl ORDER BY start_ts))
SELECT series_id, tbl AS "table", 'copied' AS part, start_ts, state, sum, mean, mn AS min, mx AS max, CAST(0 AS BIGINT) AS position, CAST(0 AS BIGINT) AS omitted FROM before
UNION ALL SELECT series_id, tbl, 'generated', start_ts, state, sum, mean, mn, mx, pos, 0 FROM later WHERE pos <= 3 OR pos > n - 3 OR n <= 6
UNION ALL SELECT DISTINCT series_id, tbl, 'omitted', NULL, NULL, NULL, NULL, NULL, NULL, 4, n - 6 FROM later WHERE n > 6""",
    "change_report": _with(F, EDITED, changes("stats", "edited")) + f"SELECT {FLAT_CHANGES} FROM changes",
    "change_report_by_cells": _with(F, EDITED, EDITED_FEW, changes("stats", "edited_few")) + f"SELECT {FLAT_CHANGES} FROM changes",
    "change_report_text": _with(F, EDITED, changes("stats", "edited"))
    + f"""SELECT series_id, tbl AS "table", start_ts, {_time('start_ts')} AS start, {_change('state')} AS state, {_change('sum')} AS sum,
       CASE WHEN d_created_ts THEN coalesce({_time('created_ts_old')}, '(none)') || ' -> ' || coalesce({_time('created_ts_new')}, '(none)') ELSE '' END
         AS created_ts FROM changes""",
    "changed_columns": _with(F, EDITED, changes("stats", "edited"))
    + """SELECT series_id, tbl AS "table", concat_ws(',', """
    + ", ".join(
        f"CASE WHEN bool_or(d_{c}) THEN '{c}' END" for c in ("created_ts", "last_reset_ts", "max", "mean", "min", "state", "sum")
    )
    + ") AS columns FROM changes GROUP BY series_id, tbl",
    "change_report_condensed": _with(F, EDITED, changes("stats", "edited"), condensed("changes"))
    + f"SELECT {FLAT_CHANGES}, omitted_before FROM condensed",
    "snapshot_after_predecessors": _with(planned()) + f"SELECT {STAT_COLUMNS} FROM current_rows",
    "planned_changes": _with(planned(), changes("current_rows", "later_rows")) + f"SELECT {FLAT_CHANGES} FROM changes",
    "planned_changes_condensed": _with(planned(), changes("current_rows", "later_rows"), condensed("changes"))
    + f"SELECT {FLAT_CHANGES}, omitted_before FROM condensed",
    "applied_changes_after_swap": _with(planned(), changes("current_rows", "later_rows"))
    + f"SELECT {FLAT_CHANGES} FROM changes",
    "replacement_eligibility": _with(F, pairs(), CLASSES, ELIGIBLE)
    + """SELECT old_id, new_id, kind, old_end, new_start, reason IS NULL AS eligible, reason,
       coalesce(new_start <= send, FALSE) AS overlaps_statistics FROM reasons""",
    "eligibility_without_target": _with(F, pairs(), CLASSES, ELIGIBLE)
    + """, known AS (
  SELECT r.old_id, r.new_id, coalesce(r.reason, CASE WHEN c.state_class = 'measurement' THEN 'no target id' END) AS reason
  FROM reasons r LEFT JOIN classes c ON c.series_id = r.new_id)
SELECT old_id, new_id, reason IS NULL AS eligible, reason FROM known""",
    "splice_counts": _with(ALL_KINDS, CLASSES, ELIGIBLE)
    + """SELECT series_id, tbl AS "table", count(*) AS row_count FROM generated
WHERE series_id IN (SELECT new_id FROM eligible) GROUP BY ALL""",
    "splice_result": _with(ALL_KINDS, CLASSES, ELIGIBLE)
    + f"""SELECT {STAT_COLUMNS} FROM (SELECT * FROM stats WHERE series_id NOT IN (SELECT new_id FROM eligible)
  UNION ALL SELECT * FROM generated WHERE series_id IN (SELECT new_id FROM eligible))""",
    "replace_series_result": _with(ALL_KINDS)
    + f"""SELECT {STAT_COLUMNS} FROM (SELECT * FROM stats WHERE series_id NOT IN (SELECT new_id FROM pairs)
  UNION ALL SELECT * FROM generated)""",
    "replace_series_target_rows": _with(generation("total", "hourly", True, marks="text"))
    + """SELECT CAST(substr(split_part(series_id, '_', 1), 9) AS BIGINT) * 2 + 1 AS metadata_id,
       start_ts, state, sum, last_reset FROM generated""",
    "replace_series_target_rows_both": _with(from_stored("total"))
    + """SELECT tbl AS "table", CAST(substr(split_part(series_id, '_', 1), 9) AS BIGINT) * 2 + 1 AS metadata_id,
       start_ts, state, sum, last_reset FROM generated""",
    "replace_series_both_tables": _with(from_stored(None))
    + f"""SELECT {STAT_COLUMNS} FROM (SELECT * FROM stored WHERE series_id NOT IN (SELECT new_id FROM pairs)
  UNION ALL SELECT * FROM generated)""",
    "splice_text_marks": _with(from_stored(None), CLASSES, ELIGIBLE)
    + f"""SELECT {STAT_COLUMNS} FROM (SELECT * FROM stored WHERE series_id NOT IN (SELECT new_id FROM eligible)
  UNION ALL SELECT * FROM generated WHERE series_id IN (SELECT new_id FROM eligible))""",
    "pairs_without_target_id": _with(pairs(), CLASSES)
    + """SELECT new_id, old_id, kind, zero AS started_from_0, 'no target id' AS reason FROM pairs
WHERE new_id NOT IN (SELECT series_id FROM classes WHERE state_class <> 'measurement')""",
    "registry_entities": _with(REGISTRY)
    + """SELECT CAST(k AS VARCHAR) AS site, entity_id, 'u' || k AS unique_id,
       CASE WHEN half = 'old' THEN nation ELSE nation + k % 2 END AS option_b FROM halves""",
    "registry_errors": _with(REGISTRY)
    + """SELECT CAST(k AS VARCHAR) AS site, CASE m WHEN 17 THEN 'invalid JSON' WHEN 18 THEN 'data.entities is not a list'
       ELSE 'root is not an object' END AS error FROM docs WHERE m IN (17, 18, 19)""",
    "registry_lookup": _with(REGISTRY)
    + "SELECT CAST(k AS VARCHAR) AS site, entity_id, 'Meter' AS name FROM halves WHERE entity_id = 'sensor.c7_new'",
    "entity_state_classes": _with(REGISTRY)
    + """SELECT CAST(k AS VARCHAR) AS site, entity_id,
       CASE WHEN k % 5 = 0 THEN 'total' WHEN half = 'old' THEN 'total_increasing' ELSE 'measurement' END AS state_class FROM halves""",
    "entity_attribute_diff": _with(REGISTRY, f"cells AS ({attribute_rows()})")
    + """SELECT CAST(k AS VARCHAR) AS site, 'sensor.c' || k || '_old' AS old_id, 'sensor.c' || k || '_new' AS new_id, path, old_value, new_value,
       CASE WHEN old_value = new_value THEN 'same' ELSE 'different' END AS diff, CAST(rank AS INTEGER) AS rank
FROM cells WHERE NOT (old_value = 'null' AND new_value = 'null')""",
    "entity_attribute_diff_sites": _with(REGISTRY, f"cells AS ({attribute_rows()})")
    + """SELECT CAST(k AS VARCHAR) AS site, 'sensor.c_old' AS old_id, 'sensor.c_new' AS new_id, path, old_value, new_value,
       CASE WHEN old_value = new_value THEN 'same' ELSE 'different' END AS diff, CAST(rank AS INTEGER) AS rank
FROM cells WHERE NOT (old_value = 'null' AND new_value = 'null')""",
    "attribute_probe": _with(F)
    + """, p AS (
  SELECT series_id, ts, state, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC, row_id DESC) AS position,
         CASE WHEN row_id % 2 = 0 THEN '{"last_reset":"2020-01-01T00:00:00Z"}' ELSE attrs END AS payload,
         CASE WHEN row_id % 2 = 0 THEN '2020-01-01T00:00:00Z' ELSE reset END AS last_reset FROM states)
SELECT series_id, CAST(position AS INTEGER) AS position, ts, state, last_reset, CASE WHEN last_reset IS NOT NULL THEN 'STRING' END AS kind,
       CAST(NULL AS VARCHAR) AS problem, payload
FROM p WHERE position <= 5""",
    "states_from_dictionary": _with(F)
    + """SELECT series_id, ts, row_id, state, attrs,
       CASE WHEN row_id % 2 = 0 THEN '{"last_reset":"2020-01-01T00:00:00Z"}' END AS attrs_fallback FROM states""",
    "states_for_detection": _with(F) + "SELECT series_id, ts, row_id, state, attrs FROM states WHERE attrs IS NOT NULL",
    "states_from_legacy": _with(F)
    + """SELECT series_id, floor(ts) AS ts, row_id, CAST(cents AS VARCHAR) AS state, e.props AS attrs
FROM readings r JOIN events e ON e.event_id = r.row_id""".replace("floor(ts)", "floor(r.ts)"),
    "states_from_legacy_zones": _with(F)
    # In January the zones are 5 hours behind, 5.5 and 1 hours ahead of UTC.
    + """SELECT series_id, floor(ts) - CASE row_id % 3 WHEN 0 THEN -18000 WHEN 1 THEN 19800 ELSE 3600 END AS ts, row_id,
       CAST(cents AS VARCHAR) AS state FROM readings""",
    "statistics_from_dictionary": _with(F)
    + """SELECT series_id, tbl AS "table", i AS interval_s, start_ts, row_id, state, sum, CAST(NULL AS DOUBLE) AS mean,
       CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max,
       strftime(make_timestamp(CAST(last_reset_ts AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS last_reset,
       CAST(NULL AS DOUBLE) AS last_reset_ts, CAST(NULL AS DOUBLE) AS created_ts FROM stats WHERE tbl = 'statistics'""",
    "statistics_from_dictionaries": _with(F, STORED) + f"SELECT {STAT_COLUMNS} FROM stored",
    "statistics_of_successors": _with(F, pairs(None))
    + f"SELECT {STAT_COLUMNS} FROM stats WHERE series_id IN (SELECT new_id FROM pairs WHERE kind = 'total')",
    "state_numbers": _with(F)
    + f"""SELECT row_id, CASE WHEN state IS NULL THEN 0.0 ELSE {LEADING} END AS leading, try_cast(state AS DOUBLE) AS whole,
       NOT ({AVAILABLE}) AS unavailable, CAST(trunc(ts / 3600) AS BIGINT) * 3600 AS hour FROM states""",
    "reset_mark_times": _with(F)
    + """SELECT row_id, t AS mark, t AS instant, CAST(NULL AS DOUBLE) AS naive_instant, t AS utc
FROM (SELECT row_id, epoch(try_cast(replace(substr(reset, 1, 19), 'T', ' ') AS TIMESTAMP)) AS t FROM states)""",
}
