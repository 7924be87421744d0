"""DuckDB SQL for the registered queries, over the whole tables.

The file counts of ``compact`` and ``storage_stats`` have no SQL twin; ``compact_rows`` and ``compact_facts`` have.
"""

from __future__ import annotations

from logfold.catalog.queries import AMPLIFY_FACTOR, AMPLIFY_RATIO, DAY_EPS, DIGITS, HIGH_FACTOR, HIGH_RATIO

ORACLES: dict[str, str] = {}

DEFAULT_EPS = 0.02


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def _normalize(text: str) -> str:
    for pattern, token in (
            ("[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}", "{UUID}"),
            (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "{IP}"), ("[0-9]+", "{NUM}"), ('"[^"]*"', "{STR}")):
        text = f"regexp_replace({text}, '{pattern}', '{token}', 'g')"
    return text


def _signature(level: str = "level", component: str = "component", message: str = "message") -> str:
    return f"{level} || '|' || {component} || '|' || {_normalize(message)}"


def _letters(index: str) -> str:
    parts, shorter = [], 0
    for p in range(14):
        parts.append(f"CASE WHEN {index} >= {shorter} THEN "
                     f"chr(CAST(97 + (({index} - {shorter}) // {26 ** p}) % 26 AS INTEGER)) ELSE '' END")
        shorter += 26 ** (p + 1)
        if shorter >= 2 ** 63:
            break
    return "(" + " || ".join(reversed(parts)) + ")"


def _round(columns: str) -> str:
    """``a, b`` to the rounded columns of the same names."""
    return ", ".join(f"round({c.strip()}, {DIGITS}) AS {c.strip()}" for c in columns.split(","))


# Log views

def _event_log(entity: str) -> str:
    return f"""elog AS (SELECT *, {_signature()} AS sig,
        strlen(level) + strlen(component) + strlen(message) AS bytes FROM (
        SELECT event_id, epoch_us(ts) AS ts_us, CAST(CAST(ts AS DATE) - DATE '2024-01-01' + 1 AS INTEGER) AS workload_id,
            CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, event_type AS component,
            'user ' || {_letters(entity)} || ' ' || event_type || ' ' || props AS message FROM events))"""


BY_USER = _event_log("(user_id % 10)")
DAILY = _event_log("(user_id % (5 * day(ts)))")
RAW_LINES = """raw_lines AS (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS message,
    CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS pos FROM documents)"""
LINES = RAW_LINES + f""",
lines AS (SELECT *, {_signature('upper(lang)', 'source')} AS sig FROM raw_lines)"""
ITEMS = f"""items AS (SELECT {_signature('l_linestatus', 'l_returnflag',
    "('order ' || l_orderkey || ' part ' || l_partkey || ' line ' || l_linenumber)")} AS sig FROM lineitem)"""
CHATS = f"""elog AS (SELECT conv_id AS workload_id, {_signature('role', "'chat'", 'text')} AS sig,
    strlen(role) + strlen('chat') + strlen(text) AS bytes FROM conversations)"""


def _schedule(eps: float) -> str:
    return f"""sched(e) AS (SELECT CAST(1 AS BIGINT) UNION ALL
    SELECT greatest(e + 1, CAST(ceil(e * (1 + CAST({eps} AS DOUBLE))) AS BIGINT)) FROM sched WHERE e < 100000000),
steps AS (SELECT e, row_number() OVER (ORDER BY e) AS rk FROM sched)"""


# Run tables: the log folded per workload and signature, then per workload and strategy

FOLD = """per AS (SELECT workload_id, sig, count(*) AS n, sum(bytes) AS all_bytes, max(bytes) AS doc_bytes
    FROM elog GROUP BY ALL),
per_b AS (SELECT per.*, steps.e AS stored, steps.rk AS sent FROM per ASOF JOIN steps ON per.n >= steps.e),
wl AS (SELECT workload_id, CAST(sum(n) AS BIGINT) AS N, count(*) AS U, CAST(sum(stored) AS BIGINT) AS bounded,
    CAST(sum(sent) AS BIGINT) AS sent, CAST(sum(all_bytes) AS BIGINT) AS raw_bytes,
    CAST(sum(doc_bytes + 2 * strlen(sig) + 9) AS BIGINT) AS folded FROM per_b GROUP BY ALL),
runs AS (SELECT p AS pipeline, workload_id, 1 - U / N AS dup_ratio, N, CASE p WHEN 'A' THEN N ELSE U END AS M,
    CASE p WHEN 'A' THEN raw_bytes ELSE folded END AS storage,
    CASE p WHEN 'B' THEN bounded ELSE N END AS reconstructed,
    CASE p WHEN 'B' THEN sent ELSE N END AS forwarded
    FROM wl, (VALUES ('A'), ('B'), ('C')) AS t(p))"""

CUT = """placed AS (SELECT *, row_number() OVER (PARTITION BY workload_id ORDER BY ts_us, event_id) AS spot,
    count(*) OVER (PARTITION BY workload_id) AS total FROM elog)"""

RESTART = CUT + """,
epochs AS (SELECT workload_id, sig, count(*) FILTER (spot <= floor(0.5 * total)) AS n0,
    count(*) FILTER (spot > floor(0.5 * total)) AS n1, sum(bytes) AS all_bytes, max(bytes) AS doc_bytes
    FROM placed GROUP BY ALL),
kept AS (SELECT *, CASE WHEN n1 > 0 THEN n1 ELSE n0 END AS last_n FROM epochs),
kept_b AS (SELECT kept.*, (SELECT max(e) FROM steps WHERE e <= last_n) AS stored,
    coalesce((SELECT max(rk) FROM steps WHERE e <= n0), 0) + coalesce((SELECT max(rk) FROM steps WHERE e <= n1), 0) AS sent
    FROM kept),
fwl AS (SELECT workload_id, CAST(sum(n0 + n1) AS BIGINT) AS N, count(*) AS U, CAST(sum(last_n) AS BIGINT) AS exact,
    CAST(sum(stored) AS BIGINT) AS bounded, CAST(sum(sent) AS BIGINT) AS sent,
    CAST(sum(all_bytes) AS BIGINT) AS raw_bytes,
    CAST(sum(doc_bytes + 2 * strlen(sig) + 9) AS BIGINT) AS folded FROM kept_b GROUP BY ALL),
fruns AS (SELECT p AS pipeline, workload_id, 1 - U / N AS dup_ratio, N, CASE p WHEN 'A' THEN N ELSE U END AS M,
    CASE p WHEN 'A' THEN raw_bytes ELSE folded END AS storage,
    CASE p WHEN 'A' THEN N WHEN 'B' THEN bounded ELSE exact END AS reconstructed,
    CASE p WHEN 'B' THEN sent ELSE N END AS forwarded
    FROM fwl, (VALUES ('A'), ('B'), ('C')) AS t(p))"""


def _metrics(runs: str, out: str, settled: str = "true") -> str:
    band = "CASE WHEN dup_ratio <= 0.30 THEN 'low' WHEN dup_ratio <= 0.70 THEN 'med' ELSE 'high' END"
    return f"""{out}_sized AS (SELECT *, storage / M AS bytes_per_doc FROM {runs}),
{out}_flagged AS (SELECT *, bytes_per_doc / median(bytes_per_doc) OVER (PARTITION BY pipeline) AS bloat FROM {out}_sized),
{out}_valid AS (SELECT *, bloat <= 1.5 AND {settled} AS storage_valid FROM {out}_flagged),
{out} AS (SELECT r.pipeline, r.workload_id, r.dup_ratio, {band.replace('dup_ratio', 'r.dup_ratio')} AS category,
    r.N, r.M, r.reconstructed, r.storage, r.storage_valid, r.bytes_per_doc, r.bloat,
    CASE WHEN r.storage_valid THEN 1 - r.storage / b.storage END AS SRR, r.dup_ratio AS SRR_theoretical,
    r.N / r.M AS CE, least(1.0, r.reconstructed / r.N) AS IPR, r.forwarded
    FROM {out}_valid r LEFT JOIN (SELECT * FROM {out}_valid WHERE pipeline = 'A' AND storage_valid) b
    ON r.workload_id = b.workload_id)"""


DAY_RUNS = (DAILY, _schedule(DAY_EPS), FOLD)
NORMAL = (*DAY_RUNS, _metrics("runs", "normal"))
BOTH = (*NORMAL, RESTART, _metrics("fruns", "failure"))
CHAT_METRICS = (CHATS, _schedule(DEFAULT_EPS), FOLD, _metrics("runs", "normal"))

# Signatures and collapse

ORACLES["normalize_lines"] = _with(RAW_LINES) + f"""
SELECT doc_id, pos, {_normalize('message')} AS template FROM raw_lines"""

ORACLES["signature_counts"] = _with(LINES) + "SELECT sig, count(*) AS count FROM lines GROUP BY sig"

ORACLES["duplication_by_source"] = _with(LINES) + f"""
SELECT source, N, U, round(1 - U / N, {DIGITS}) AS dup_ratio, round(N / U, {DIGITS}) AS CE,
    CASE WHEN 1 - U / N <= 0.3 THEN 'low' WHEN 1 - U / N <= 0.7 THEN 'med' ELSE 'high' END AS category
FROM (SELECT source, count(*) AS N, count(DISTINCT sig) AS U FROM lines GROUP BY source)"""

ORACLES["last_record_per_signature"] = _with(BY_USER) + """
SELECT sig AS _agg_id, sig AS _agg_signature, c AS count, true AS aggregated, event_id, message, workload_id
FROM (SELECT *, row_number() OVER (PARTITION BY sig ORDER BY ts_us DESC, event_id DESC) AS back,
    count(*) OVER (PARTITION BY sig) AS c FROM elog) WHERE back = 1"""

COUNTED = """counted AS (SELECT *, row_number() OVER (PARTITION BY sig ORDER BY ts_us, event_id) AS c FROM elog)"""

ORACLES["index_running_count"] = _with(BY_USER, COUNTED) + """
SELECT event_id, sig AS _agg_id, c AS count FROM counted"""

ORACLES["index_running_count_split"] = ORACLES["index_running_count"]

ORACLES["first_sighting"] = _with(LINES) + """
SELECT sig, doc_id, pos, message FROM (
    SELECT *, row_number() OVER (PARTITION BY sig ORDER BY doc_id, pos) AS rn FROM lines) WHERE rn = 1"""

ORACLES["distinct_documents"] = _with(LINES) + "SELECT DISTINCT sig FROM lines"

ORACLES["edge_emissions"] = _with(BY_USER, COUNTED, _schedule(DEFAULT_EPS)) + """
SELECT event_id, sig AS _agg_id, c AS count FROM counted WHERE c IN (SELECT e FROM sched)"""

_EDGE = """
SELECT sig, n, e AS stored, rk AS forwarded
FROM (SELECT sig, count(*) AS n FROM {log} GROUP BY sig) c ASOF JOIN steps ON c.n >= steps.e"""
ORACLES["edge_stored_counts"] = _with(BY_USER, _schedule(DEFAULT_EPS)) + _EDGE.format(log="elog")
ORACLES["edge_stored_counts_items"] = _with(ITEMS, _schedule(DEFAULT_EPS)) + _EDGE.format(log="items")

ORACLES["hot_signatures"] = _with(ITEMS) + """
SELECT sig, count(*) AS count FROM items GROUP BY sig ORDER BY count DESC, sig LIMIT 20"""

ORACLES["emission_share"] = _with(ITEMS, _schedule(DEFAULT_EPS)) + f"""
SELECT CAST(sum(n) AS BIGINT) AS lines, CAST(sum(stored) AS BIGINT) AS stored, CAST(sum(forwarded) AS BIGINT) AS forwarded,
    round(sum(stored) / sum(n), {DIGITS}) AS ipr, round(sum(forwarded) / sum(n), {DIGITS}) AS share
FROM ({_EDGE.format(log='items')})"""

# Run tables and metrics

_RUN_COLUMNS = f"pipeline, workload_id, {_round('dup_ratio')}, N, M"
ORACLES["strategy_runs"] = _with(*DAY_RUNS) + f"""
SELECT {_RUN_COLUMNS}, storage, reconstructed, forwarded FROM runs"""

ORACLES["measured_runs"] = f"""SELECT pipeline, workload_id, dup_ratio, N, M, reconstructed, forwarded, true AS settled, true AS stored
FROM ({ORACLES["strategy_runs"]})"""

ORACLES["sketched_duplication"] = _with(DAILY) + """
SELECT component, CAST(count(*) AS BIGINT) AS N, CAST(count(DISTINCT sig) AS BIGINT) AS U, true AS within_two_percent FROM elog GROUP BY component"""

ORACLES["cut_records"] = _with(DAILY, CUT) + """
SELECT workload_id, total AS rows, ts_us AS cut_ts_us, event_id AS cut_event_id
FROM placed WHERE spot = floor(0.5 * total)"""

ORACLES["restart_runs"] = _with(DAILY, _schedule(DAY_EPS), RESTART) + f"""
SELECT {_RUN_COLUMNS}, reconstructed, forwarded, 'restart' AS failed FROM fruns"""

_METRIC_COLUMNS = f"""pipeline, workload_id, category, N, M, reconstructed, storage, storage_valid,
    {_round('dup_ratio, bytes_per_doc, bloat, SRR, SRR_theoretical, CE, IPR')}"""
ORACLES["run_metrics"] = _with(*NORMAL) + f"SELECT {_METRIC_COLUMNS} FROM normal"

ORACLES["pipeline_medians"] = _with(*DAY_RUNS) + f"""
SELECT pipeline, round(median(storage / M), {DIGITS}) AS median FROM runs GROUP BY pipeline"""

_COMPARISON = f"""
SELECT s.pipeline, s.category, count(*) AS N_Runs, count(*) FILTER (storage_valid) AS N_Storage,
    CAST(round_even(round_even(avg(M), 4), 0) AS BIGINT) AS Avg_Docs,
    round_even(round_even(avg(storage) FILTER (storage_valid), 4) / 1048576, 2) AS Avg_Storage_MB,
    round_even(avg(SRR) FILTER (storage_valid), 4) AS SRR_Mean,
    round_even(stddev_samp(SRR) FILTER (storage_valid), 4) AS SRR_Std,
    round_even(avg(s.IPR), 4) AS IPR_Mean, round(any_value(f.ipr), {DIGITS}) AS IPR_Failure,
    round_even(1 - any_value(f.ipr), 4) AS FLR_Mean, round_even(avg(CE), 4) AS CE_Mean
FROM normal s LEFT JOIN (SELECT pipeline, category, avg(IPR) AS ipr FROM failure GROUP BY ALL) f
    ON s.pipeline = f.pipeline AND s.category = f.category
GROUP BY s.pipeline, s.category"""
ORACLES["comparison_table"] = _with(*BOTH) + _COMPARISON

# Run tables as they come from files: counts blank or with a fraction, runs that did not settle.
_TOLD = """told AS (SELECT * REPLACE (CASE WHEN workload_id % 7 = 0 THEN M ELSE reconstructed END AS reconstructed),
    NOT (pipeline = 'B' AND workload_id % 5 = 0) AS settled FROM runs)"""
ANALYSIS = (*DAY_RUNS, _TOLD, _metrics("told", "normal", "settled"), RESTART, _metrics("fruns", "failure"))
ORACLES["analyze_runs"] = _with(*ANALYSIS) + _COMPARISON

ORACLES["ipr_grid"] = _with(*BOTH) + f"""
SELECT p AS pipeline, c AS category,
    round(coalesce((SELECT avg(IPR) FROM normal WHERE pipeline = p AND category = c), 0), {DIGITS}) AS normal,
    round(coalesce((SELECT avg(IPR) FROM failure WHERE pipeline = p AND category = c), 0), {DIGITS}) AS failure
FROM (VALUES ('A'), ('B'), ('C')) AS a(p), (VALUES ('low'), ('med'), ('high')) AS b(c)"""

ORACLES["failure_impact"] = _with(*BOTH) + f"""
SELECT n.pipeline, round(n.ipr, {DIGITS}) AS ipr_normal, round(f.ipr, {DIGITS}) AS ipr_failure
FROM (SELECT pipeline, avg(IPR) AS ipr FROM normal GROUP BY ALL) n
LEFT JOIN (SELECT pipeline, avg(IPR) AS ipr FROM failure GROUP BY ALL) f ON n.pipeline = f.pipeline"""

PAIRS = """pairs AS (SELECT n.*, f.IPR AS IPR_failure, f.reconstructed AS reconstructed_failure,
    n.IPR - f.IPR AS FLR, 1 - f.IPR AS loss_failure
    FROM normal n LEFT JOIN failure f ON n.pipeline = f.pipeline AND n.workload_id = f.workload_id)"""

ORACLES["tradeoff"] = _with(*BOTH, PAIRS) + f"""
SELECT pipeline, workload_id, {_round('SRR, FLR, loss_failure')} FROM pairs WHERE SRR IS NOT NULL"""

ORACLES["srr_by_dup"] = _with(*NORMAL) + f"""
SELECT pipeline, workload_id, round(dup_ratio * 100, {DIGITS}) AS dup_pct, round(SRR * 100, {DIGITS}) AS srr_pct,
    round(SRR_theoretical * 100, {DIGITS}) AS srr_theoretical_pct FROM normal WHERE SRR IS NOT NULL"""

ORACLES["ipr_vs_dup"] = _with(*BOTH) + f"""
SELECT 'normal' AS mode, pipeline, workload_id, round(dup_ratio * 100, {DIGITS}) AS dup_pct, {_round('IPR')} FROM normal
UNION ALL
SELECT 'failure', pipeline, workload_id, round(dup_ratio * 100, {DIGITS}), round(IPR, {DIGITS}) FROM failure"""

ORACLES["storage_line"] = _with(*CHAT_METRICS) + f"""
SELECT pipeline, workload_id, round(storage / 1048576, {DIGITS}) AS storage_mb, storage_valid AS included FROM normal"""

_EXCLUDED = """
SELECT pipeline, workload_id, round(bloat, 1) AS bloat, excluded, runs, CAST(1.5 AS DOUBLE) AS factor,
    'wl' || workload_id || '(' || coalesce(format('{:.1f}', round(bloat, 1)), 'nan') || 'x)' AS label FROM (
    SELECT *, count(*) FILTER (NOT storage_valid) OVER (PARTITION BY pipeline) AS excluded,
        count(*) OVER (PARTITION BY pipeline) AS runs FROM normal) WHERE NOT storage_valid"""
ORACLES["exclusion_report"] = _with(*CHAT_METRICS) + _EXCLUDED
ORACLES["analyze_exclusions"] = _with(*ANALYSIS) + _EXCLUDED

ORACLES["storage_smoothed"] = _with(*DAY_RUNS) + f"""
SELECT pipeline, workload_id, {_round('mb, med, mad')}, outlier, round(avg(clean) OVER w3, {DIGITS}) AS smoothed
FROM (SELECT *, mb > med + 3 * (mad + 1) AS outlier, CASE WHEN mb > med + 3 * (mad + 1) THEN med ELSE mb END AS clean
    FROM (SELECT *, median(abs(mb - med)) OVER w5 AS mad
        FROM (SELECT *, median(mb) OVER w5 AS med FROM (SELECT pipeline, workload_id, storage / 16 AS mb FROM runs)
            WINDOW w5 AS (PARTITION BY pipeline ORDER BY workload_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
        WINDOW w5 AS (PARTITION BY pipeline ORDER BY workload_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)))
WINDOW w3 AS (PARTITION BY pipeline ORDER BY workload_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"""

BANDED = """banded AS (SELECT pipeline, workload_id, storage,
    CASE WHEN dup_ratio <= 0.3 THEN 'low' WHEN dup_ratio <= 0.7 THEN 'med' ELSE 'high' END AS category,
    row_number() OVER w AS rn, count(*) OVER (PARTITION BY pipeline) AS total
    FROM runs WINDOW w AS (PARTITION BY pipeline ORDER BY workload_id))"""

ORACLES["category_regions"] = _with(*DAY_RUNS, BANDED) + """
SELECT pipeline, region, any_value(category) AS category, min(workload_id) AS start, max(workload_id) AS "end"
FROM (SELECT *, CAST(sum(fresh) OVER (PARTITION BY pipeline ORDER BY workload_id) AS BIGINT) AS region
    FROM (SELECT *, CASE WHEN category = lag(category) OVER (PARTITION BY pipeline ORDER BY workload_id)
        THEN 0 ELSE 1 END AS fresh FROM banded))
GROUP BY pipeline, region"""

ORACLES["storage_by_workload"] = _with(*DAY_RUNS, BANDED) + f"""
SELECT pipeline, workload_id, round(storage / 1048576, {DIGITS}) AS mb, category, rn - 1 AS position,
    (rn - 1) % greatest(1, total // 20) = 0 AS tick FROM banded"""

ORACLES["axis_ticks"] = _with(*DAY_RUNS, BANDED) + """
SELECT pipeline, rn - 1 AS position, workload_id FROM banded WHERE (rn - 1) % greatest(1, total // 8) = 0"""

GROWTH = """per AS (SELECT workload_id, sig, count(*) AS n, sum(bytes) AS all_bytes, max(bytes) AS doc_bytes
    FROM elog GROUP BY ALL),
firsts AS (SELECT sig, min(workload_id) AS workload_id, arg_min(doc_bytes, workload_id) AS doc_bytes FROM per GROUP BY sig),
added AS (SELECT workload_id, sum(n) AS docs, sum(all_bytes) AS bytes FROM per GROUP BY ALL),
added_f AS (SELECT workload_id, count(*) AS docs, sum(doc_bytes + 2 * strlen(sig) + 9) AS bytes FROM firsts GROUP BY ALL),
grown AS (SELECT pipeline, workload_id, CAST(sum(docs) OVER w AS BIGINT) AS M, CAST(sum(bytes) OVER w AS BIGINT) AS total_storage
    FROM (SELECT 'A' AS pipeline, workload_id, docs, bytes FROM added UNION ALL
        SELECT p, a.workload_id, coalesce(f.docs, 0), coalesce(f.bytes, 0)
        FROM (VALUES ('B'), ('C')) AS t(p), added a LEFT JOIN added_f f ON a.workload_id = f.workload_id)
    WINDOW w AS (PARTITION BY pipeline ORDER BY workload_id))"""

ORACLES["cumulative_growth"] = _with(DAILY, GROWTH) + f"""
SELECT pipeline, workload_id, round(total_storage / 1048576, {DIGITS}) AS total_mb FROM grown"""

SIXES = "sixes AS (SELECT * REPLACE (CAST(floor(workload_id / 6) AS BIGINT) AS workload_id) FROM elog)"

ORACLES["cumulative_growth_stored"] = _with(DAILY, SIXES, GROWTH.replace("elog", "sixes")) + """
SELECT pipeline, workload_id, n AS "N", M, total_storage FROM grown JOIN
    (SELECT workload_id, count(*) AS n FROM sixes GROUP BY workload_id) USING (workload_id)"""

ORACLES["cumulative_summary"] = _with(DAILY, GROWTH) + """
SELECT pipeline AS Pipeline, count(*) AS Workloads, arg_max(M, workload_id) AS Final_Docs,
    round_even(arg_max(total_storage, workload_id) / 1048576, 2) AS Final_Storage_MB,
    round_even(1 - arg_max(total_storage, workload_id)
        / (SELECT arg_max(total_storage, workload_id) FROM grown WHERE pipeline = 'A'), 4) AS Cumulative_SRR
FROM grown GROUP BY pipeline"""

ORACLES["restart_loss"] = _with(*BOTH, PAIRS) + f"""
SELECT pipeline, workload_id, N, reconstructed, reconstructed_failure, round(IPR, {DIGITS}) AS IPR_normal,
    {_round('IPR_failure, FLR, loss_failure')} FROM pairs"""

ORACLES["recommend_strategy"] = _with(*BOTH, PAIRS) + f"""
SELECT w.workload_id, round(w.dup_ratio, {DIGITS}) AS dup_ratio, b.pipeline, round(b.SRR, {DIGITS}) AS SRR,
    round(b.IPR, {DIGITS}) AS IPR, round(b.FLR, {DIGITS}) AS FLR, b.forwarded
FROM (SELECT workload_id, max(dup_ratio) AS dup_ratio FROM normal GROUP BY ALL) w
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY workload_id ORDER BY SRR DESC, forwarded, pipeline) AS rn
    FROM pairs WHERE SRR IS NOT NULL AND 1 - IPR <= 0.1 AND FLR <= 0.5) b
    ON w.workload_id = b.workload_id AND b.rn = 1"""

ORACLES["missing_runs"] = _with(DAILY) + """
SELECT 'clean_slate' AS mode, p AS pipeline, workload_id
FROM (SELECT DISTINCT workload_id FROM elog) w, (VALUES ('A'), ('B'), ('C')) AS t(p)
WHERE workload_id NOT IN (SELECT workload_id FROM elog WHERE level = 'ERROR' AND message LIKE 'user a %')"""

ORACLES["missing_runs_modes"] = _with(DAILY) + """
SELECT 'failure' AS mode, p AS pipeline, workload_id
FROM (SELECT DISTINCT workload_id FROM elog) w, (VALUES ('A'), ('B'), ('C')) AS t(p)
WHERE workload_id NOT IN (SELECT workload_id FROM elog WHERE level = 'ERROR' AND message LIKE 'user a %')"""

ORACLES["restart_null_times"] = _with(DAILY) + """
SELECT workload_id, CAST(sum(n) AS BIGINT) AS N, count(*) AS U, CAST(sum(CASE WHEN n1 > 0 THEN n1 ELSE n END) AS BIGINT) AS kept
FROM (SELECT workload_id, sig, count(*) AS n, count(*) FILTER (spot > floor(0.2 * total)) AS n1
      FROM (SELECT workload_id, sig, count(*) OVER (PARTITION BY workload_id) AS total, row_number() OVER (PARTITION BY workload_id
                ORDER BY CASE WHEN event_id % 3 <> 0 THEN ts_us END NULLS FIRST, event_id) AS spot FROM elog) GROUP BY ALL)
GROUP BY workload_id"""

ORACLES["exclusion_summary"] = _with(*CHAT_METRICS) + """
SELECT coalesce(pipeline, 'all') AS pipeline, count(*) FILTER (NOT storage_valid) AS excluded, count(*) AS runs,
    count(*) FILTER (NOT storage_valid) = 0 AS merged FROM normal GROUP BY ROLLUP (pipeline)"""

ORACLES["ingest_completeness"] = """
WITH ev AS (SELECT event_type AS run, user_id, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS hour FROM events),
ops AS (SELECT run, hour, count(*) AS c FROM ev GROUP BY ALL),
docs AS (SELECT run, hour, count(*) AS c
    FROM (SELECT run, user_id, min(hour) AS hour FROM ev GROUP BY ALL) GROUP BY ALL),
polls AS (SELECT o.run, o.hour AS poll, sum(o.c) OVER w AS ops,
    sum(CASE WHEN o.run IN ('click', 'signup') THEN o.c ELSE coalesce(d.c, 0) END) OVER w AS docs,
    row_number() OVER w AS i, sum(o.c) OVER (PARTITION BY o.run) * CASE WHEN o.run = 'view' THEN 2 ELSE 1 END AS target
    FROM ops o LEFT JOIN docs d ON o.run = d.run AND o.hour = d.hour WINDOW w AS (PARTITION BY o.run ORDER BY o.hour)),
flats AS (SELECT *, CASE WHEN i > 3 AND docs > 0
    AND docs = lag(docs) OVER (PARTITION BY run ORDER BY poll) THEN 1 ELSE 0 END AS flat FROM polls),
blocks AS (SELECT *, sum(1 - flat) OVER (PARTITION BY run ORDER BY poll) AS block FROM flats),
still AS (SELECT *, sum(flat) OVER (PARTITION BY run, block ORDER BY poll) AS stable FROM blocks),
found AS (SELECT run, CAST(max(target) AS BIGINT) AS target, CAST(max(ops) AS BIGINT) AS ops,
    min(poll) FILTER (ops >= target // 2) AS half_poll, min(poll) FILTER (ops >= target * 99 // 100) AS done_poll,
    min(poll) FILTER (stable >= 10) AS plateau_poll FROM still GROUP BY run)
SELECT *, least(done_poll, plateau_poll) AS complete_poll,
    CASE WHEN done_poll IS NOT NULL AND (plateau_poll IS NULL OR done_poll <= plateau_poll) THEN 'target'
         WHEN plateau_poll IS NOT NULL THEN 'plateau' ELSE 'open' END AS reason FROM found"""

def _amplified(table: str, key: str, factor: int, ratio: float) -> str:
    return f"""size AS (SELECT count(*) * {factor} AS total,
    CAST(round_even(count(*) * {factor} * (1 - {ratio}), 0) AS BIGINT) AS kept FROM {table}),
slots AS (SELECT i AS slot, CASE WHEN i < kept THEN i ELSE least(kept - 1, CAST(floor(kept * pow(
    CAST(CAST('0x' || substr(md5('42-' || i), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0, 2.0)) AS BIGINT)) END AS idx,
    row_number() OVER (ORDER BY md5('42-order-' || i), i) - 1 AS position
    FROM size, range((SELECT total FROM size)) AS t(i)),
base AS (SELECT *, row_number() OVER (ORDER BY {key}) - 1 AS idx FROM {table}),
amplified AS (SELECT s.position, s.slot, s.idx, b.* EXCLUDE (idx) FROM slots s JOIN base b ON s.idx = b.idx)"""


AMPLIFIED = _amplified("documents", "doc_id", AMPLIFY_FACTOR, AMPLIFY_RATIO)

ORACLES["amplify"] = _with(AMPLIFIED) + """
SELECT position, slot, idx AS "index", doc_id, source, epoch_us(TIMESTAMP '2025-01-01 00:00:00') + position AS ts_us
FROM amplified"""

ORACLES["contract_check"] = _with(AMPLIFIED, _schedule(DEFAULT_EPS), f"""signed AS (SELECT {_signature(
    'upper(lang)', 'source', "('doc ' || " + _letters('doc_id') + " || ' has ' || n_chars || ' chars')")} AS sig
    FROM amplified)""", """folded AS (SELECT sig, n, e AS stored
    FROM (SELECT sig, count(*) AS n FROM signed GROUP BY sig) c ASOF JOIN steps ON c.n >= steps.e)""") + f"""
SELECT CAST(sum(n) AS BIGINT) AS N, count(*) AS U, any_value(kept) AS "expected_U", round(sum(n) / count(*), {DIGITS}) AS CE,
    round(any_value(total) / any_value(kept), {DIGITS}) AS "expected_CE",
    round(sum(stored) / any_value(total), {DIGITS}) AS IPR_B, round(sum(n) / any_value(total), {DIGITS}) AS IPR_C,
    sum(n) = any_value(total) AS lines_ok, count(*) = any_value(kept) AS distinct_ok,
    abs(sum(n) / count(*) - any_value(total) / any_value(kept)) < 1e-9 AS ce_ok,
    sum(stored) / any_value(total) >= 1 / 1.02 - 1e-9 AS bound_ok
FROM folded, size"""

ORACLES["high_duplication_runs"] = _with(
    _amplified("events", "event_id", HIGH_FACTOR, HIGH_RATIO), f"""texts AS (SELECT event_type AS component,
        CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
        'user ' || {_letters('event_id')} || ' sent ' || props AS message FROM amplified),
elog AS (SELECT 1 AS workload_id, {_signature()} AS sig,
    strlen(level) + strlen(component) + strlen(message) AS bytes FROM texts)""",
    _schedule(DEFAULT_EPS), FOLD, _metrics("runs", "normal")) + f"""
SELECT pipeline, N, M, reconstructed, forwarded, storage,
    {_round('dup_ratio, bytes_per_doc, SRR, CE, IPR')} FROM normal"""

# Shaping

ORACLES["merge_json"] = """
SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
    CASE WHEN event_type = 'error' THEN 'raw ' || props END AS message FROM events"""

ORACLES["merge_json_open"] = """
SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, CAST(NULL AS VARCHAR) AS message,
    CASE WHEN event_type = 'error' THEN '{"k":"x' || user_id || '","extra":"' || event_id || '"}' END AS _rest FROM events"""

ORACLES["json_paths"] = """
SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, 0.0::DOUBLE AS absent FROM events"""

ORACLES["lift_nested"] = """
SELECT event_id, 'workload-' || (user_id % 5 + 1) AS k8s_pod_name, event_type AS k8s_container_name FROM events"""

ORACLES["field_lookup"] = f"""
SELECT event_id, {_signature(
    "CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END",
    "CASE WHEN user_id % 3 < 2 THEN event_type ELSE 'unknown' END",
    "CASE WHEN user_id % 2 = 0 OR user_id % 3 = 0 THEN '' ELSE props END")} AS sig FROM events"""

ORACLES["enrich"] = """
SELECT o_orderkey, o_custkey AS c_custkey, c_name, n_name FROM orders
LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey"""

ORACLES["coerced_counts"] = """
SELECT o_orderkey, CAST(split_part(o_orderpriority, '-', 1) AS BIGINT) AS level, CAST(0 AS BIGINT) AS whole,
    CAST(0 AS BIGINT) AS negative,
    CASE WHEN floor(o_totalprice - 100000) = 0 THEN o_custkey ELSE CAST(floor(o_totalprice - 100000) AS BIGINT) END AS documents
FROM orders"""

ORACLES["entity_letters"] = f"SELECT o_orderkey, {_letters('o_orderkey')} AS token FROM orders"

ORACLES["log_file_fields"] = """
SELECT c_custkey, 'kube.var.log.containers.log-workload-' || c_custkey || '_default_emitter-' || md5(c_name) || '.log' AS tag,
    'log-workload-' || c_custkey AS pod_name, 'default' AS namespace_name, 'emitter' AS container_name, md5(c_name) AS container_id
FROM customer WHERE c_mktsegment <> 'BUILDING'"""

# Sources and tables

_STAMP = "doc_id * 1000000 + pos"
ORACLES["read_cri"] = _with(RAW_LINES) + f"""
SELECT {_STAMP} AS time_us, CASE WHEN pos % 2 = 0 THEN 'stdout' ELSE 'stderr' END AS stream, 'F' AS logtag, message AS log
FROM raw_lines
WHERE 32 + strlen(CASE WHEN pos % 2 = 0 THEN 'stdout' ELSE 'stderr' END) + 2 + strlen(message) <= 2000"""

ORACLES["cri_unparsed"] = _with(RAW_LINES) + f"""
SELECT CASE WHEN pos % 3 <> 0 THEN {_STAMP} END AS time_us, CASE WHEN pos % 3 <> 0 THEN 'stdout' END AS stream,
    message AS log, pos % 3 <> 0 AS parsed FROM raw_lines"""

ORACLES["read_docker"] = _with(RAW_LINES) + f"SELECT {_STAMP} AS time_us, message AS log, 'stdout' AS stream FROM raw_lines"

ORACLES["cri_to_documents"] = _with(BY_USER) + "SELECT sig, count(*) AS count FROM elog GROUP BY sig"

ORACLES["read_json_logs"] = _with(BY_USER) + """
SELECT CAST(event_id AS VARCHAR) AS event_id, level, message, CAST(NULL AS VARCHAR) AS pod, CAST(NULL AS VARCHAR) AS _corrupt
FROM elog"""

ORACLES["read_runs"] = _with(*DAY_RUNS) + f"""
SELECT {_RUN_COLUMNS}, storage, reconstructed, 'false' AS failed, CAST(NULL AS BOOLEAN) AS settled FROM runs"""

_LAST = _with(BY_USER) + """
SELECT sig, event_id, ts_us, message FROM (
    SELECT *, row_number() OVER (PARTITION BY sig ORDER BY ts_us DESC, event_id DESC) AS back FROM elog) WHERE back = 1"""
ORACLES["upsert_snapshot"] = ORACLES["upsert_bucketed"] = _LAST
ORACLES["merge_on_read"] = _LAST

ORACLES["compact_rows"] = _LAST

ORACLES["compact_facts"] = _with(BY_USER) + """
SELECT state, docs, CASE WHEN state = 'before' THEN twice ELSE 0 END AS superseded, state = 'after' AS settled, true AS stored
FROM (SELECT count(DISTINCT sig) AS docs FROM elog), (VALUES ('before'), ('after')) AS t(state),
    (SELECT count(*) AS twice FROM (SELECT sig FROM elog GROUP BY sig HAVING min(workload_id) <= 15 AND max(workload_id) > 15))"""

ORACLES["append_table"] = _with(BY_USER) + "SELECT event_id, sig FROM elog"

# Streams

ORACLES["stream_counts"] = _with(BY_USER) + """
SELECT sig AS _agg_id, c AS count, event_id, message FROM (
    SELECT *, row_number() OVER (PARTITION BY sig ORDER BY ts_us DESC, event_id DESC) AS back,
        count(*) OVER (PARTITION BY sig) AS c FROM elog) WHERE back = 1"""

ORACLES["stream_cri"] = _with(BY_USER) + """
SELECT sig AS _agg_id, c AS count, event_id, ts_us, message FROM (
    SELECT *, row_number() OVER (PARTITION BY sig ORDER BY ts_us DESC, event_id DESC) AS back,
        count(*) OVER (PARTITION BY sig) AS c FROM elog) WHERE back = 1"""

ORACLES["stream_edge"] = _with(BY_USER, _schedule(DEFAULT_EPS)) + """
SELECT sig AS _agg_id, e AS count FROM (SELECT sig, count(*) AS n FROM elog GROUP BY sig) c ASOF JOIN steps ON c.n >= steps.e"""

ORACLES["stream_emissions"] = ORACLES["edge_emissions"]
for _name in ("edge_emissions", "cut_records", "amplify"):
    ORACLES[f"{_name}_split"] = ORACLES[_name]
