"""Every registered query: a name and a function of (spark, folder of tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, LongType, StructField, StructType

from logfold.catalog import views as V
from logfold.functions import masking as K
from logfold.functions import scalars as S
from logfold.operators import folding, shaping, tables
from logfold.operators.amplify import amplify_duplicates
from logfold.operators.ranking import cut_points, group_median
from logfold.plans import advice, analysis, growth, measured, metrics, reports, runs, sketches
from logfold.session import materialize, scratch_path
from logfold.sources import files
from logfold.streaming import folds

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DAY_EPS = 0.5
DIGITS = 6
AMPLIFY_FACTOR, AMPLIFY_RATIO = 4, 0.75
HIGH_FACTOR, HIGH_RATIO = 10, 0.9
PROPS = StructType([StructField("k", LongType())])


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to a fixed number of digits, so that engines can be compared."""
    return df.select(*[
        F.round(F.col(f.name), DIGITS).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType))
        else F.col(f.name) for f in df.schema.fields])


# Run tables that several queries share. Each is small (rows per workload and strategy) and
# written once, so the report plans on top never fold the log again.

def daily_runs(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(runs.evaluate_strategies(V.daily_log(spark, sf), eps=DAY_EPS), "runs")


def daily_restart_fold(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(runs.fold_restarted(V.daily_log(spark, sf), V.EVENT_ORDER, 0.5, eps=DAY_EPS), "fold")


def daily_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.run_metrics(daily_runs(spark, sf))


def daily_pair(spark: SparkSession, sf: str, extra: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Metrics without and with a restart, from one fold of the log."""
    folded = daily_restart_fold(spark, sf)
    return (metrics.run_metrics(runs.runs_table(folded), extra),
            metrics.run_metrics(runs.runs_table(folded, restarted=True)))


def chat_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.run_metrics(materialize(runs.evaluate_strategies(V.chat_log(spark, sf)), "runs"))


def signed_events(spark: SparkSession, sf: str) -> DataFrame:
    """Signatures written once, since ranking reads them twice: first to count, then to number."""
    return materialize(V.by_user(spark, sf, 10).select("sig", *V.EVENT_ORDER), "signed")


# Signatures and collapse

@register
def normalize_lines(spark, sf):
    lines = V.line_log(spark, sf)
    return K.with_template(lines, F.col("message")).select("doc_id", "pos", "template")


@register
def signature_counts(spark, sf):
    return folding.signature_counts(K.with_signature(V.line_log(spark, sf)))


@register
def duplication_by_source(spark, sf):
    found = runs.duplication(K.with_signature(V.line_log(spark, sf)), ["source"])
    return rounded(found.withColumn("category", S.category(F.col("dup_ratio"))))


@register
def last_record_per_signature(spark, sf):
    log = V.by_user(spark, sf, 10).select("sig", "event_id", "ts_us", "message", "workload_id")
    return folding.index_documents(log, V.EVENT_ORDER).select(
        "_agg_id", "_agg_signature", "count", "aggregated", "event_id", "message", "workload_id")


@register
def index_running_count(spark, sf):
    return folding.running_counts(signed_events(spark, sf), V.EVENT_ORDER).select("event_id", "_agg_id", "count")


def _split(df: DataFrame) -> tuple[DataFrame, int]:
    """A table of about fifty even groups and a bound that some of them exceed, so that those are spread over partitions."""
    rows = materialize(df, "rows")
    return rows, max(1, rows.count() // 50)


@register
def index_running_count_split(spark, sf):
    """As ``index_running_count``, with groups on both sides of the bound."""
    rows, bound = _split(signed_events(spark, sf))
    return folding.running_counts(rows, V.EVENT_ORDER, hot_rows=bound).select("event_id", "_agg_id", "count")


@register
def first_sighting(spark, sf):
    lines = K.with_signature(V.line_log(spark, sf)).select("sig", "doc_id", "pos", "message")
    return folding.first_sightings(lines, V.LINE_ORDER)


@register
def distinct_documents(spark, sf):
    return folding.distinct_documents(K.with_signature(V.line_log(spark, sf)).select("sig")).select("sig")


@register
def edge_emissions(spark, sf):
    return folding.edge_emissions(signed_events(spark, sf), V.EVENT_ORDER).select("event_id", "_agg_id", "count")


@register
def edge_emissions_split(spark, sf):
    """As ``edge_emissions``, with groups on both sides of the bound."""
    rows, bound = _split(signed_events(spark, sf))
    return folding.edge_emissions(rows, V.EVENT_ORDER, hot_rows=bound).select("event_id", "_agg_id", "count")


@register
def edge_stored_counts(spark, sf):
    return folding.edge_counts(V.by_user(spark, sf, 10))


@register
def edge_stored_counts_items(spark, sf):
    return folding.edge_counts(V.item_log(spark, sf))


@register
def hot_signatures(spark, sf):
    items = V.item_log(spark, sf)
    return folding.hot_signatures(items, 20)


@register
def emission_share(spark, sf):
    """How much of the log strategy B forwards and preserves, over all line items."""
    counts = folding.edge_counts(V.item_log(spark, sf))
    return rounded(counts.agg(
        F.sum("n").alias("lines"), F.sum("stored").alias("stored"), F.sum("forwarded").alias("forwarded"))
        .select("lines", "stored", "forwarded", S.preserved(F.col("stored"), F.col("lines")).alias("ipr"),
                (F.col("forwarded") / F.col("lines")).alias("share")))


# Run tables and metrics

@register
def strategy_runs(spark, sf):
    return rounded(runs.evaluate_strategies(V.daily_log(spark, sf), eps=DAY_EPS).select(
        "pipeline", "workload_id", "dup_ratio", "N", "M", "storage", "reconstructed", "forwarded"))


@register
def measured_runs(spark, sf):
    """The strategies' tables of the daily log, written and measured by their files and stored counts."""
    root = scratch_path(spark, "strategies")
    log = V.daily_log(spark, sf).select("workload_id", "sig", "level", "component", "message", *V.EVENT_ORDER)
    measured.store_strategies(log, root, V.EVENT_ORDER, DAY_EPS)
    return rounded(measured.measure_runs(spark, root, DAY_EPS).select(
        "pipeline", "workload_id", "dup_ratio", "N", "M", "reconstructed", "forwarded", "settled", (F.col("storage") > 0).alias("stored")))


@register
def sketched_duplication(spark, sf):
    """Signatures of each component over all days, from sketches stored by component and day, against the exact count."""
    path = scratch_path(spark, "sketches")
    log = V.daily_log(spark, sf).select("component", "workload_id", "sig")
    sketches.store_sketches(log, path, ["component", "workload_id"])
    exact = runs.duplication(log, ["component"]).select("component", "N", "U")
    merged = sketches.estimated_duplication(spark, path, ["component"]).select("component", F.col("N").alias("lines"), F.col("U").alias("guess"))
    close = (F.abs(F.col("guess") - F.col("U")) <= 0.02 * F.col("U")) & (F.col("lines") == F.col("N"))
    return exact.join(merged, "component").select("component", "N", "U", close.alias("within_two_percent"))


@register
def cut_records(spark, sf):
    return cut_points(V.daily_log(spark, sf), ["workload_id"], V.EVENT_ORDER, 0.5).select(
        "workload_id", "rows", "cut_ts_us", "cut_event_id")


@register
def cut_records_split(spark, sf):
    """As ``cut_records``, with every sliver of more than one row spread over partitions."""
    return cut_points(V.daily_log(spark, sf), ["workload_id"], V.EVENT_ORDER, 0.5, hot_rows=1).select(
        "workload_id", "rows", "cut_ts_us", "cut_event_id")


@register
def restart_runs(spark, sf):
    return rounded(runs.runs_table(daily_restart_fold(spark, sf), restarted=True).select(
        "pipeline", "workload_id", "dup_ratio", "N", "M", "reconstructed", "forwarded", "failed"))


@register
def run_metrics(spark, sf):
    return rounded(daily_metrics(spark, sf))


@register
def pipeline_medians(spark, sf):
    sized = daily_runs(spark, sf).withColumn("bytes_per_doc", S.bytes_per_doc(F.col("storage"), F.col("M")))
    return rounded(group_median(sized, ["pipeline"], "bytes_per_doc"))


@register
def comparison_table(spark, sf):
    return rounded(reports.comparison_table(*daily_pair(spark, sf)))


@register
def ipr_grid(spark, sf):
    return rounded(reports.ipr_grid(*daily_pair(spark, sf)))


@register
def failure_impact(spark, sf):
    return rounded(reports.failure_impact(*daily_pair(spark, sf)))


@register
def tradeoff(spark, sf):
    return rounded(reports.tradeoff(*daily_pair(spark, sf)))


@register
def srr_by_dup(spark, sf):
    return rounded(reports.srr_by_dup(daily_metrics(spark, sf)))


@register
def ipr_vs_dup(spark, sf):
    return rounded(reports.ipr_vs_dup(*daily_pair(spark, sf)))


@register
def storage_line(spark, sf):
    return rounded(reports.storage_line(chat_metrics(spark, sf)))


@register
def exclusion_report(spark, sf):
    return rounded(reports.exclusion_report(chat_metrics(spark, sf)).select(
        "pipeline", "workload_id", "bloat", "excluded", "runs", "label", "factor"))


def _analysis(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Run tables written as files, with blank counts, counts with a fraction, and runs that did not settle; then read and analyzed."""
    folded = daily_restart_fold(spark, sf)
    normal, failure = runs.runs_table(folded), runs.runs_table(folded, restarted=True)
    told = F.when(F.col("workload_id") % 7 != 0, F.concat(F.col("reconstructed").cast("string"), F.lit(".5")))
    settled = F.when((F.col("pipeline") == "B") & (F.col("workload_id") % 5 == 0), " False ").otherwise("true")
    paths = scratch_path(spark, "runs_csv"), scratch_path(spark, "failure_csv")
    files.write_csv(normal.drop("forwarded").withColumns({"reconstructed": told, "settled": settled}), paths[0])
    files.write_csv(failure.drop("forwarded", "settled"), paths[1])
    return analysis.analyze_runs(spark, *paths)


@register
def analyze_runs(spark, sf):
    return rounded(_analysis(spark, sf)["comparison"])


@register
def analyze_exclusions(spark, sf):
    return rounded(_analysis(spark, sf)["exclusions"].select(
        "pipeline", "workload_id", "bloat", "excluded", "runs", "label", "factor"))


@register
def storage_smoothed(spark, sf):
    return rounded(reports.storage_smoothed(daily_runs(spark, sf), unit=16.0))


@register
def category_regions(spark, sf):
    return reports.category_regions(daily_runs(spark, sf))


@register
def storage_by_workload(spark, sf):
    return rounded(reports.storage_by_workload(daily_runs(spark, sf)))


@register
def axis_ticks(spark, sf):
    table = reports.storage_by_workload(daily_runs(spark, sf), ticks=8)
    return table.where("tick").select("pipeline", "position", "workload_id")


@register
def cumulative_growth(spark, sf):
    return rounded(reports.cumulative_growth(runs.cumulative_runs(V.daily_log(spark, sf))))


@register
def cumulative_growth_stored(spark, sf):
    """The shared store grown by six days at a time; each step folds its own days only."""
    six = F.floor(F.col("workload_id") / 6).cast("long")
    log = materialize(V.daily_log(spark, sf).select(six.alias("workload_id"), "sig", "bytes"), "log")
    path = scratch_path(spark, "growth")
    for row in log.select("workload_id").distinct().orderBy("workload_id").collect():
        growth.add_workload(log.where(F.col("workload_id") == row.workload_id), path, row.workload_id)
    return growth.grown(spark, path)


@register
def cumulative_summary(spark, sf):
    return rounded(reports.cumulative_summary(runs.cumulative_runs(V.daily_log(spark, sf))))


@register
def restart_loss(spark, sf):
    return rounded(advice.restart_loss(*daily_pair(spark, sf)))


@register
def recommend_strategy(spark, sf):
    return rounded(advice.recommend(
        *daily_pair(spark, sf, ("forwarded",)), 0.1, 0.5))


@register
def missing_runs(spark, sf):
    """Runs expected of every day, where days without errors among their first users gave none."""
    log = V.daily_log(spark, sf)
    matrix = runs.experiment_matrix(log.select("workload_id").distinct())
    errors = log.where((F.col("level") == "ERROR") & F.col("message").startswith("user a "))
    done = runs.evaluate_strategies(errors, eps=DAY_EPS)
    return runs.missing_runs(matrix, done).select("mode", "pipeline", "workload_id")


@register
def missing_runs_modes(spark, sf):
    """Two modes expected of every day; one was run for all, the other for days with early errors."""
    log = V.daily_log(spark, sf)
    modes = ("clean_slate", "failure")
    matrix = runs.experiment_matrix(log.select("workload_id").distinct(), modes)
    errors = log.where((F.col("level") == "ERROR") & F.col("message").startswith("user a "))
    done = [runs.evaluate_strategies(part, eps=DAY_EPS).withColumn("mode", F.lit(mode)) for part, mode in zip((log, errors), modes)]
    return runs.missing_runs(matrix, done[0].unionByName(done[1])).select("mode", "pipeline", "workload_id")


@register
def restart_null_times(spark, sf):
    """The daily counts after a restart where a third of the records has no time."""
    log = V.daily_log(spark, sf).withColumn("ts_us", F.when(F.col("event_id") % 3 != 0, F.col("ts_us")))
    folded = runs.fold_restarted(log, V.EVENT_ORDER, 0.2, eps=DAY_EPS)
    return folded.select("workload_id", "N", "U", "kept")


@register
def exclusion_summary(spark, sf):
    return reports.exclusion_summary(chat_metrics(spark, sf))


@register
def ingest_completeness(spark, sf):
    """Hourly polls of each event type; some keep every event as a document, some one per user."""
    return advice.ingest_completeness(V.ingest_progress(spark, sf))


@register
def amplify(spark, sf):
    docs = V.table(spark, sf, "documents").select("doc_id", "lang", "source")
    total = docs.count() * AMPLIFY_FACTOR
    out = amplify_duplicates(docs, ["doc_id"], total, AMPLIFY_RATIO)
    return out.select("position", "slot", "index", "doc_id", "source", S.micros("timestamp").alias("ts_us"))


@register
def amplify_split(spark, sf):
    """As ``amplify``, ranked in many ranges and with the repeats of hot records in many parts."""
    docs = V.table(spark, sf, "documents").select("doc_id", "lang", "source")
    total = docs.count() * AMPLIFY_FACTOR
    bound = max(1, total // 50)
    out = amplify_duplicates(docs, ["doc_id"], total, AMPLIFY_RATIO, hot_rows=bound, salt_rows=max(1, total // 1000))
    return out.select("position", "slot", "index", "doc_id", "source", S.micros("timestamp").alias("ts_us"))


@register
def contract_check(spark, sf):
    """The documents, told apart by letters, amplified and folded again."""
    docs = V.table(spark, sf, "documents").select(
        "doc_id", F.upper("lang").alias("level"), F.col("source").alias("component"),
        F.concat(F.lit("doc "), S.letters("doc_id"), F.lit(" has "), F.col("n_chars"),
                 F.lit(" chars")).alias("message"))
    total = docs.count() * AMPLIFY_FACTOR
    stream = K.with_signature(amplify_duplicates(docs, ["doc_id"], total, AMPLIFY_RATIO))
    return rounded(advice.validate_contract(stream, total, AMPLIFY_RATIO))


@register
def high_duplication_runs(spark, sf):
    """Every event told apart by letters, then nine repeats for each on average: one hot-tailed
    workload as seen at 90 % duplication, under all strategies."""
    events = V.table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"),
        F.col("event_type").alias("component"),
        F.concat(F.lit("user "), S.letters("event_id"), F.lit(" sent "), F.col("props")).alias("message"))
    total = events.count() * HIGH_FACTOR
    stream = K.with_signature(amplify_duplicates(events, ["event_id"], total, HIGH_RATIO))
    log = stream.select(F.lit(1).alias("workload_id"), "sig", V.record_bytes(*V.SIZED).alias("bytes"))
    found = metrics.run_metrics(materialize(runs.evaluate_strategies(log), "runs"), ("forwarded",))
    return rounded(found.select("pipeline", "dup_ratio", "N", "M", "reconstructed", "forwarded", "storage",
                                "bytes_per_doc", "SRR", "CE", "IPR"))


# Shaping

@register
def merge_json(spark, sf):
    """The props decoded into the record; rows whose props are cut short stay text."""
    rows = V.table(spark, sf, "events").select("event_id", F.when(
        F.col("event_type") == "error", F.concat(F.lit("raw "), F.col("props"))).otherwise(F.col("props")).alias("log"))
    return shaping.merge_json(rows, "log", PROPS).select("event_id", "k", "message")


@register
def merge_json_open(spark, sf):
    """Records with a field of another type and a key outside of the schema lose neither."""
    extra = F.concat(F.lit('{"k":"x'), F.col("user_id"), F.lit('","extra":"'), F.col("event_id"), F.lit('"}'))
    rows = V.table(spark, sf, "events").select("event_id", F.when(
        F.col("event_type") == "error", extra).otherwise(F.col("props")).alias("log"))
    return shaping.merge_json(rows, "log", PROPS).select("event_id", "k", "message", "_rest")


@register
def json_paths(spark, sf):
    return V.table(spark, sf, "events").select(
        "event_id", S.json_number(F.col("props"), "$.k").alias("k"),
        S.json_number(F.col("props"), "$.aggregations.recon.value").alias("absent"))


@register
def lift_nested(spark, sf):
    nested = V.table(spark, sf, "events").select("event_id", F.struct(
        F.concat(F.lit("workload-"), F.col("user_id") % 5 + 1).alias("pod_name"),
        F.col("event_type").alias("container_name")).alias("kubernetes"))
    return shaping.lift(nested, "kubernetes", "k8s_")


@register
def field_lookup(spark, sf):
    """Names with and without prefix, and defaults where both are missing."""
    rows = V.table(spark, sf, "events").select(
        "event_id", F.when(F.col("user_id") % 3 == 0, F.col("event_type")).alias("component"),
        F.when(F.col("user_id") % 3 == 1, F.col("event_type")).alias("log_component"),
        F.when(F.col("user_id") % 2 == 0, F.lit("")).alias("message"),
        F.when(F.col("event_type") == "error", "ERROR").alias("log_level"), "props")
    rows = rows.withColumn("log_message", F.when(F.col("component").isNull(), F.col("props"))).drop("props")
    return K.with_signature(rows).select("event_id", "sig")


@register
def enrich(spark, sf):
    orders = V.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    customer = V.table(spark, sf, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("n_nationkey"))
    nation = V.table(spark, sf, "nation").select("n_nationkey", "n_name")
    return shaping.enrich(shaping.enrich(orders, customer, ["c_custkey"]), nation, ["n_nationkey"]).select(
        "o_orderkey", "c_custkey", "c_name", "n_name")


@register
def coerced_counts(spark, sf):
    orders = V.table(spark, sf, "orders")
    return orders.select(
        "o_orderkey", S.count_or_zero(F.substring_index("o_orderpriority", "-", 1)).alias("level"),
        S.count_or_zero(F.col("o_orderpriority")).alias("whole"),
        S.count_or_zero(F.concat(F.lit("-"), F.col("o_custkey"))).alias("negative"),
        S.reconstructed_or_docs(F.col("o_totalprice") - 100000, F.col("o_custkey")).alias("documents"))


@register
def entity_letters(spark, sf):
    return V.table(spark, sf, "orders").select("o_orderkey", S.letters("o_orderkey").alias("token"))


@register
def log_file_fields(spark, sf):
    """Log files of customers; those of one segment carry another tag and are routed away."""
    path = F.concat(F.lit("file:/var/log/containers/log-workload-"), F.col("c_custkey"), F.lit("_default_emitter-"),
                    F.md5("c_name"), F.lit(".log"))
    rows = V.table(spark, sf, "customer").select("c_custkey", "c_mktsegment", path.alias("path"))
    fields = files.file_fields(F.col("path"))
    tag = F.when(F.col("c_mktsegment") == "BUILDING", shaping.path_tag(F.col("path"), "host")).otherwise(
        shaping.path_tag(F.col("path")))
    tagged = rows.select("c_custkey", tag.alias("tag"), *[c.alias(n) for n, c in fields.items()])
    return shaping.route(tagged, "kube.*")


# Sources and tables

def _stamp(us: Column) -> Column:
    return F.date_format(S.plus_micros("1970-01-01 00:00:00", us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


@register
def read_cri(spark, sf):
    """Document lines written as container log lines, read back without the long ones."""
    path = scratch_path(spark, "cri")
    stamp = _stamp(F.col("doc_id") * 1000000 + F.col("pos"))
    V.line_log(spark, sf).select(F.concat(
        stamp, F.lit("789Z "), F.when(F.col("pos") % 2 == 0, "stdout").otherwise("stderr"), F.lit(" F "),
        F.col("message"))).write.text(path)
    parsed = files.read_cri_logs(spark, path, "*.txt", 2000)
    return parsed.select(F.unix_micros("time").alias("time_us"), "stream", "logtag", "log")


@register
def cri_unparsed(spark, sf):
    """Every third document line is written without the container's fields and read back whole."""
    path = scratch_path(spark, "cri")
    lines = V.line_log(spark, sf)
    framed = F.concat(_stamp(F.col("doc_id") * 1000000 + F.col("pos")), F.lit("789Z stdout F "), F.col("message"))
    lines.select(F.when(F.col("pos") % 3 == 0, F.col("message")).otherwise(framed)).write.text(path)
    return files.read_cri_logs(spark, path, "*.txt").select(F.unix_micros("time").alias("time_us"), "stream", "log", "parsed")


@register
def read_docker(spark, sf):
    path = scratch_path(spark, "docker")
    stamp = _stamp(F.col("doc_id") * 1000000 + F.col("pos"))
    V.line_log(spark, sf).select(F.to_json(F.struct(
        stamp.alias("time"), F.col("message").alias("log"), F.lit("stdout").alias("stream")))).write.text(path)
    parsed = files.read_docker_logs(spark, path)
    return parsed.select(F.unix_micros("time").alias("time_us"), "log", "stream")


def _container_logs(spark: SparkSession, sf: str) -> str:
    """The event log as container log files whose lines hold JSON records."""
    path = scratch_path(spark, "containers")
    record = F.struct("level", "component", "message", F.col("event_id").cast("string").alias("event_id"))
    V.by_user(spark, sf, 10).select(F.concat(
        _stamp(F.col("ts_us")), F.lit("001Z stdout F "), F.to_json(record))).write.text(path)
    return path


@register
def cri_to_documents(spark, sf):
    """The whole way: JSON records inside container lines, parsed, merged, signed and counted."""
    path = _container_logs(spark, sf)
    merged = shaping.merge_json(files.read_cri_logs(spark, path, "*.txt"), "log", files.EVENT_SCHEMA)
    return folding.signature_counts(K.with_signature(shaping.route(merged, "kube.*")))


@register
def read_json_logs(spark, sf):
    path = scratch_path(spark, "json")
    V.by_user(spark, sf, 10).select(F.to_json(F.struct(
        "level", "component", "message", F.col("event_id").cast("string").alias("event_id")))).write.text(path)
    return files.read_json_logs(spark, path).select("event_id", "level", "message", "pod", "_corrupt")


@register
def read_runs(spark, sf):
    path = scratch_path(spark, "runs_csv")
    files.write_csv(daily_runs(spark, sf).drop("settled", "forwarded"), path)
    return rounded(files.read_runs(spark, path).select(
        "pipeline", "workload_id", "dup_ratio", "N", "M", "storage", "reconstructed", "failed", "settled"))


def _halves(spark, sf):
    log = V.by_user(spark, sf, 10).select("sig", "event_id", "ts_us", "message", "workload_id")
    early = F.col("workload_id") <= 15
    parts = [log.where(early), log.where(~early)]
    return [materialize(folding.last_records(p.drop("workload_id"), V.EVENT_ORDER), "half") for p in parts]


@register
def upsert_snapshot(spark, sf):
    """The second half of the month upserted into the first, twice."""
    first, second = _halves(spark, sf)
    once = tables.upsert(first, second, "sig", V.EVENT_ORDER)
    return tables.upsert(once, second, "sig", V.EVENT_ORDER)


@register
def upsert_bucketed(spark, sf):
    """The second half upserted into a bucketed snapshot of the first, twice; the snapshot is not shuffled."""
    first, second = _halves(spark, sf)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    snapshot = tables.write_bucketed(first, scratch_path(spark, "snapshot"), "sig", buckets)
    once = tables.write_bucketed(tables.upsert_bucketed(snapshot, second, "sig", V.EVENT_ORDER), scratch_path(spark, "snapshot"), "sig", buckets)
    return tables.upsert_bucketed(once, second, "sig", V.EVENT_ORDER)


def _keyed_table(spark, sf):
    first, second = _halves(spark, sf)
    path = scratch_path(spark, "keyed")
    tables.write_batch(first, path, 0)
    tables.write_batch(second, path, 1)
    tables.write_batch(second, path, 1)
    return path, first.schema


@register
def merge_on_read(spark, sf):
    path, schema = _keyed_table(spark, sf)
    return tables.read_latest(spark, path, schema, "sig")


@register
def compact(spark, sf):
    path, schema = _keyed_table(spark, sf)
    target = scratch_path(spark, "compacted")
    tables.compact_table(spark, path, target, schema, "sig")
    check = tables.settle_check(spark, target, schema, "sig")
    return check.select("files", "docs", "superseded", "settled")


@register
def compact_rows(spark, sf):
    """What a compacted table holds."""
    path, schema = _keyed_table(spark, sf)
    target = scratch_path(spark, "compacted")
    tables.compact_table(spark, path, target, schema, "sig")
    return tables.read_batches(spark, target, schema).drop("batch")


@register
def compact_facts(spark, sf):
    """Documents, superseded rows and whether a table is settled, before and after compaction."""
    path, schema = _keyed_table(spark, sf)
    target = scratch_path(spark, "compacted")
    tables.compact_table(spark, path, target, schema, "sig")
    facts = [tables.settle_check(spark, p, schema, "sig").select(
        F.lit(name).alias("state"), "docs", "superseded", "settled", (F.col("bytes") > 0).alias("stored"))
        for name, p in (("before", path), ("after", target))]
    return facts[0].unionByName(facts[1])


@register
def append_table(spark, sf):
    """Every event of an append table written in two parts."""
    log = V.by_user(spark, sf, 10).select("event_id", "sig")
    path = scratch_path(spark, "appended")
    for part in (0, 1):
        tables.append_records(log.where(F.col("event_id") % 2 == part), path)
    return spark.read.schema(log.schema).parquet(path)


@register
def storage_stats(spark, sf):
    """Bytes on disk of the three tables the strategies write for the same log."""
    log = V.by_user(spark, sf, 10).select("sig", "event_id", "ts_us", "message")
    result = None
    for name, frame in (("A", folding.keep_all(log)),
                        ("B", folding.edge_emissions(log, V.EVENT_ORDER)),
                        ("C", folding.index_documents(log, V.EVENT_ORDER))):
        path = scratch_path(spark, f"stored_{name}")
        if name == "A":
            tables.append_records(frame, path)
        else:
            tables.write_batch(tables.latest(frame, "_agg_id", ("count",)), path, 0)
        row = tables.storage_stats(spark, path).select(F.lit(name).alias("pipeline"), "files", "bytes")
        result = row if result is None else result.unionByName(row)
    return result


# Streams: the event log arrives in three parts; each part is one micro-batch of its own run,
# so the second and third run resume from the checkpoint.

def _stream(spark, sf, label, start):
    log = V.by_user(spark, sf, 10).select("sig", "event_id", "ts_us", "message", "workload_id")
    source, out, checkpoint = (scratch_path(spark, f"{label}_{part}") for part in ("in", "out", "check"))
    schema = log.drop("workload_id").schema
    for low, high in ((1, 10), (11, 20), (21, None)):
        part = F.col("workload_id") >= low
        if high:
            part &= F.col("workload_id") <= high
        log.where(part).drop("workload_id").write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        start(stream, out, checkpoint).awaitTermination()
    return out, folds.document_schema(log.drop("workload_id"))


@register
def stream_counts(spark, sf):
    out, schema = _stream(spark, sf, "counts", lambda s, o, c: folds.fold_counts(s, o, c, V.EVENT_ORDER, merge_every=2))
    return folds.read_documents(spark, out, schema).select("_agg_id", "count", "event_id", "message")


@register
def stream_cri(spark, sf):
    """Container log files as a stream: parsed, merged, signed, counted and upserted."""
    source, out, checkpoint = _container_logs(spark, sf), scratch_path(spark, "cri_out"), scratch_path(spark, "cri_check")
    logs = files.stream_logs(spark, source, "*.txt", files_per_trigger=4)
    merged = K.with_signature(shaping.merge_json(shaping.route(logs, "kube.*"), "log", files.EVENT_SCHEMA))
    records = merged.select("sig", F.unix_micros("time").alias("ts_us"), F.col("event_id").cast("long"), "message")
    folds.fold_counts(records, out, checkpoint, V.EVENT_ORDER).awaitTermination()
    found = folds.read_documents(spark, out, folds.document_schema(records))
    return found.select("_agg_id", "count", "event_id", "ts_us", "message")


@register
def stream_edge(spark, sf):
    out, schema = _stream(spark, sf, "edge", lambda s, o, c: folds.fold_bounded(s, o, c, V.EVENT_ORDER))
    return folds.read_documents(spark, out, schema).select("_agg_id", "count")


@register
def stream_emissions(spark, sf):
    out, schema = _stream(spark, sf, "emissions", lambda s, o, c: folds.fold_emissions(
        s, o, c, V.EVENT_ORDER))
    return folds.read_emitted(spark, out, schema).select("event_id", "_agg_id", "count")
