"""Hand-made run tables and small logs against plain Python."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from logfold.plans import advice, metrics, reports, runs
from logfold.sources.files import RUN_SCHEMA

MB = 1024 * 1024


def table(spark, rows):
    names = RUN_SCHEMA.fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], RUN_SCHEMA)


def run(pipeline, workload, ratio, n, m, storage, **extra):
    return dict(pipeline=pipeline, workload_id=workload, dup_ratio=ratio, N=n, M=m, storage=storage,
                total_storage=extra.pop("total", storage), **extra)


@pytest.fixture(scope="module")
def handmade(spark):
    return table(spark, [
        run("A", 1, 0.2, 100, 100, 1000), run("A", 2, 0.5, 100, 100, 1500),       # bloat exactly 1.5
        run("A", 3, 0.8, 100, 100, 1501), run("A", 4, 0.9, 100, 100, 1000),       # bloat just above
        run("A", 5, 0.1, 100, 100, 900), run("A", 6, 0.3, 100, 100, 1000, settled=False),
        run("B", 1, 0.2, 100, 80, 800, reconstructed=95), run("B", 3, 0.8, 100, 20, 200, reconstructed=120),
        run("B", 4, 0.9, 100, 0, 50, reconstructed=0), run("B", 9, 0.7, 100, 30, 300, reconstructed=99),
        run("B", 2, 0.5, 100, 50, 500, reconstructed=None), run("C", 1, 0.2, 0, 10, 400, reconstructed=100)])


def test_run_metrics_edge_cases(handmade):
    got = {(r.pipeline, r.workload_id): r for r in metrics.run_metrics(handmade).collect()}
    assert len(metrics.run_metrics(handmade).columns) == 15
    valid = {k: r.storage_valid for k, r in got.items()}
    assert valid[("A", 2)] and not valid[("A", 3)] and not valid[("A", 6)]
    assert not valid[("B", 4)] and got[("B", 4)].bloat is None and got[("B", 4)].CE == 0.0
    assert got[("B", 1)].SRR == pytest.approx(0.2)
    assert got[("B", 3)].SRR is None                    # baseline is invalid
    assert got[("B", 9)].SRR is None                    # baseline is missing
    assert got[("B", 3)].IPR == 1.0                     # more reconstructed than lines
    assert got[("B", 2)].reconstructed == 50 and got[("B", 2)].IPR == 0.5
    assert got[("C", 1)].IPR == 0.0 and got[("A", 1)].SRR == 0.0
    assert [got[k].category for k in (("A", 6), ("B", 9), ("A", 4))] == ["low", "med", "high"]
    assert got[("A", 1)].bloat == pytest.approx(10 / statistics.median([10, 15, 15.01, 10, 9, 10]))


def test_metrics_without_optional_columns(handmade):
    bare = handmade.drop("settled", "reconstructed", "timestamp", "failed", "seed", "total_storage")
    got = {(r.pipeline, r.workload_id): r for r in metrics.run_metrics(bare).collect()}
    assert got[("A", 6)].storage_valid and got[("B", 1)].reconstructed == 80


def test_duplicate_baseline_takes_the_later_run(spark):
    df = table(spark, [run("A", 1, 0.5, 10, 10, 100, timestamp="20250101_000000"),
                       run("A", 1, 0.5, 10, 10, 120, timestamp="20250102_000000"), run("C", 1, 0.5, 10, 5, 60)])
    assert metrics.run_metrics(df).where("pipeline = 'C'").first().SRR == 0.5


def test_comparison_table(handmade, spark):
    normal = metrics.run_metrics(handmade)
    failure = metrics.run_metrics(table(spark, [run("B", 1, 0.2, 100, 80, 800, reconstructed=61)]))
    got = {(r.pipeline, r.category): r for r in reports.comparison_table(normal, failure).collect()}
    low, med = got[("B", "low")], got[("B", "med")]
    assert (low.N_Runs, low.N_Storage, low.Avg_Docs, low.SRR_Mean, low.SRR_Std) == (1, 1, 80, 0.2, None)
    assert (low.IPR_Mean, low.IPR_Failure, low.FLR_Mean, low.CE_Mean) == (0.95, 0.61, 0.39, 1.25)
    assert (med.N_Runs, med.N_Storage, med.Avg_Docs, med.IPR_Mean, med.IPR_Failure) == (2, 2, 40, 0.745, None)
    high = got[("B", "high")]
    assert (high.N_Runs, high.N_Storage, high.SRR_Mean, high.Avg_Storage_MB) == (2, 1, None, 0.0)
    assert got[("A", "low")].SRR_Std == pytest.approx(0.0)
    without = reports.comparison_table(normal).first()
    assert without.IPR_Failure is None and without.FLR_Mean is None
    assert len(reports.comparison_table(normal).columns) == 12


def test_grids_fill_with_zero(handmade):
    normal = metrics.run_metrics(handmade)
    cells = {(r.pipeline, r.category): (r.normal, r.failure) for r in reports.ipr_grid(normal, normal).collect()}
    assert len(cells) == 9 and cells[("C", "high")] == (0.0, 0.0) and cells[("A", "low")] == (1.0, 1.0)
    assert reports.ipr_grid(normal, None).where("failure IS NOT NULL").count() == 0
    impact = {r.pipeline: r for r in reports.failure_impact(normal, None).collect()}
    assert impact["A"].ipr_normal == 1.0 and impact["A"].ipr_failure is None
    assert reports.ipr_vs_dup(normal, None).count() == 12 and reports.ipr_vs_dup(normal, normal).count() == 24


def test_loss_has_two_definitions(spark, handmade):
    normal = metrics.run_metrics(handmade)
    failure = metrics.run_metrics(table(spark, [run("B", 1, 0.2, 100, 80, 800, reconstructed=61)]))
    row = reports.tradeoff(normal, failure).where("pipeline = 'B' AND workload_id = 1").first()
    assert (round(row.FLR, 9), round(row.loss_failure, 9)) == (0.34, 0.39)
    assert reports.tradeoff(normal, failure).where("workload_id = 9").count() == 0


def test_exclusions(handmade):
    rows = reports.exclusion_report(metrics.run_metrics(handmade)).orderBy("pipeline", "workload_id").collect()
    assert [(r.pipeline, r.label, r.excluded, r.runs) for r in rows] == [
        ("A", "wl3(1.5x)", 2, 6), ("A", "wl6(1.0x)", 2, 6), ("B", "wl4(nanx)", 1, 5)]


def test_cumulative_summary(spark):
    df = table(spark, [run("A", 0, 0.0, 5, 5, 9, total=9 * MB), run("A", 1, 0.5, 10, 10, 9, total=20 * MB),
                       run("A", 2, 0.5, 10, 20, 9, total=40 * MB), run("C", 2, 0.5, 10, 7, 9, total=10 * MB),
                       run("C", 1, 0.5, 10, 5, 9, total=8 * MB)])
    got = {r.Pipeline: tuple(r)[1:] for r in reports.cumulative_summary(df).collect()}
    assert got == {"A": (2, 20, 40.0, 0.0), "C": (2, 7, 10.0, 0.75)}
    assert {r.Pipeline: r.Workloads for r in reports.cumulative_summary(df, True).collect()}["A"] == 3
    alone = reports.cumulative_summary(df.where("pipeline = 'C'")).first()
    assert (alone.Pipeline, alone.Cumulative_SRR) == ("C", 0.0)
    assert [r.total_mb for r in reports.cumulative_growth(df).where("pipeline = 'C'").collect()] == [8.0, 10.0]


@pytest.mark.parametrize("chunk_rows,hot_rows", [(10 ** 6, 10 ** 6), (4, 10), (1, 5)])
def test_smoothing(spark, chunk_rows, hot_rows):
    rng = random.Random(5)
    sizes = [rng.choice([10, 12, 11, 13, 90]) for _ in range(40)]
    df = table(spark, [run("A", i, 0.1, 1, 1, s * MB) for i, s in enumerate(sizes)])

    def around(xs, at, k):
        return xs[max(0, at - k):at + k + 1]

    med = [statistics.median(around(sizes, i, 2)) for i in range(40)]
    off = [abs(s - m) for s, m in zip(sizes, med)]
    mad = [statistics.median(around(off, i, 2)) for i in range(40)]
    outlier = [s > m + 3 * (d + 1) for s, m, d in zip(sizes, med, mad)]
    clean = [m if o else s for s, m, o in zip(sizes, med, outlier)]
    got = reports.storage_smoothed(df, chunk_rows=chunk_rows, hot_rows=hot_rows).orderBy("workload_id").collect()
    assert [(r.med, r.mad, r.outlier) for r in got] == list(zip(med, mad, outlier)) and any(outlier)
    assert [r.smoothed for r in got] == pytest.approx([statistics.mean(around(clean, i, 1)) for i in range(40)])


@pytest.mark.parametrize("chunk_rows,hot_rows", [(10 ** 6, 10 ** 6), (3, 10)])
def test_regions_and_axis(spark, chunk_rows, hot_rows):
    ratios = [0.1, 0.2, 0.5, 0.5, 0.1, 0.9, 0.9, 0.9]
    df = table(spark, [run(p, i + 10, r, 1, 1, 1) for p in "AB" for i, r in enumerate(ratios)])
    got = reports.category_regions(df, chunk_rows, hot_rows).where("pipeline = 'B'").orderBy("region").collect()
    assert [(r.region, r.category, r.start, r.end) for r in got] == [
        (1, "low", 10, 11), (2, "med", 12, 13), (3, "low", 14, 14), (4, "high", 15, 17)]
    axis = reports.storage_by_workload(df, ticks=3, hot_rows=hot_rows).where("pipeline = 'A'").orderBy("position")
    assert [(r.position, r.workload_id, r.tick) for r in axis.collect()] == [
        (i, i + 10, i % 2 == 0) for i in range(8)]


def small_log(spark, eps):
    rng = random.Random(11)
    rows = [(w, rng.choice(["aa", "aa", "aa", f"s{i % 9}"]), i, i, 10 + i % 3) for w in (1, 2) for i in range(120)]
    return rows, spark.createDataFrame(rows, "workload_id int, sig string, t long, id long, bytes long")


@pytest.mark.parametrize("eps", [0.02, 0.5])
def test_run_tables_equal_a_simulated_store(spark, eps):
    """Feed each strategy record by record into a keyed store, with and without a restart."""
    rows, df = small_log(spark, eps)
    folded = runs.fold_restarted(df, ["t", "id"], 0.5, eps=eps)
    got = {(r.pipeline, r.workload_id, mode): r for mode in (False, True)
           for r in runs.runs_table(folded, mode).collect()}
    plain = {(r.pipeline, r.workload_id): tuple(r) for r in runs.evaluate_strategies(df, eps=eps).collect()}
    for w in (1, 2):
        stream = sorted((t, i, sig, size) for ww, sig, t, i, size in rows if ww == w)
        for restart in (False, True):
            store_b, store_c, counts, last, sent = {}, {}, {}, {}, 0
            for position, (_, _, sig, _) in enumerate(stream, start=1):
                if restart and position == len(stream) // 2 + 1:
                    counts, last = {}, {}
                counts[sig] = counts.get(sig, 0) + 1
                store_c[sig] = counts[sig]
                if sig not in last or counts[sig] >= last[sig] * (1 + eps):
                    last[sig] = store_b[sig] = counts[sig]
                    sent += 1
            a, b, c = (got[(p, w, restart)] for p in "ABC")
            assert (a.reconstructed, a.M, a.storage) == (120, 120, sum(s for *_, s in stream))
            assert (b.reconstructed, b.forwarded, b.M) == (sum(store_b.values()), sent, len(store_b))
            assert (c.reconstructed, c.forwarded, c.M) == (sum(store_c.values()), 120, len(store_c))
            assert a.dup_ratio == pytest.approx(1 - len(store_b) / 120)
        assert all(plain[(p, w)] == tuple(got[(p, w, False)]) for p in "ABC")


def test_growth_counts_a_signature_once(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "a", 7), (2, "a", 9), (2, "b", 4), (3, "a", 1)],
                               "workload_id int, sig string, bytes long")
    got = {(r.pipeline, r.workload_id): (r.N, r.M, r.total_storage) for r in runs.cumulative_runs(df).collect()}
    assert [got[("A", w)] for w in (1, 2, 3)] == [(2, 2, 12), (2, 4, 25), (1, 5, 26)]
    assert [got[("C", w)] for w in (1, 2, 3)] == [(2, 1, 18), (2, 2, 33), (1, 2, 33)]


def test_recommendation(spark):
    def pair(reconstructed, crashed):
        rows = [run("A", 1, 0.9, 100, 100, 1000, reconstructed=100)]
        rows += [run(p, 1, 0.9, 100, 10, 100, reconstructed=r) for p, r in zip("BC", reconstructed)]
        crash = [run("A", 1, 0.9, 100, 100, 1000, reconstructed=100)]
        crash += [run(p, 1, 0.9, 100, 10, 100, reconstructed=r) for p, r in zip("BC", crashed)]
        normal = table(spark, rows).withColumn("forwarded", F.when(F.col("pipeline") == "B", 40).otherwise(100))
        return metrics.run_metrics(normal, ("forwarded",)), metrics.run_metrics(table(spark, crash))

    pick = lambda reconstructed, crashed: advice.recommend(*pair(reconstructed, crashed), 0.02, 0.1).first().pipeline
    assert pick((99, 100), (95, 100)) == "B"       # same saving, fewer forwarded
    assert pick((97, 100), (95, 100)) == "C"       # B loses too much without a crash
    assert pick((99, 100), (50, 50)) == "A"        # both lose too much in a crash
    assert advice.recommend(*pair((99, 100), (95, 100)), -1.0, 0.1).first().pipeline is None


@pytest.mark.parametrize("chunk_rows", [10 ** 6, 4])
def test_ingest_completeness(spark, chunk_rows):
    def polls(name, docs, ops, target=200):
        return [(name, i, d, o, target) for i, (d, o) in enumerate(zip(docs, ops), start=1)]

    steady = list(range(10, 210, 10))
    rows = polls("by volume", steady, steady) + polls("open", steady[:5], steady[:5])
    rows += polls("plateau", [10, 50] + [60] * 18, [10] * 20)
    rows += polls("broken", [60] * 9 + [61] + [61] * 9, [10] * 19)
    rows += polls("empty", [0] * 20, [0] * 20) + polls("early", [7] * 14, [0] * 14)
    df = spark.createDataFrame(rows, "run string, poll int, docs long, ops long, target long")
    got = {r.run: (r.half_poll, r.complete_poll, r.reason)
           for r in advice.ingest_completeness(df, chunk_rows=chunk_rows).collect()}
    assert got == {"by volume": (10, 20, "target"), "open": (None, None, "open"), "plateau": (None, 13, "plateau"),
                   "broken": (None, None, "open"), "empty": (None, None, "open"), "early": (None, 13, "plateau")}
    shifted = df.where("run = 'by volume'").withColumn("ops", F.col("ops") + 1000).withColumn("start_ops", F.lit(1000))
    assert advice.ingest_completeness(shifted).first().complete_poll == 20


def test_missing_runs(spark):
    workloads = spark.createDataFrame([(1,), (2,)], "workload_id int")
    matrix = runs.experiment_matrix(workloads, ("clean_slate", "failure"))
    assert matrix.count() == 12
    done = spark.createDataFrame([("A", 1), ("B", 1), ("C", 1), ("A", 2)], "pipeline string, workload_id int")
    lacking = runs.missing_runs(matrix, done)
    assert {(r.pipeline, r.workload_id) for r in lacking.collect()} == {("B", 2), ("C", 2)} and lacking.count() == 4
    lacking = runs.missing_runs(matrix, done.withColumn("mode", F.lit("failure")))
    assert lacking.count() == 8 and lacking.where("mode = 'clean_slate'").count() == 6


def test_duplication(spark):
    df = spark.createDataFrame([("p", "a")] * 3 + [("p", "b"), ("q", "a")], "g string, sig string")
    got = {r.g: tuple(r)[1:] for r in runs.duplication(df, ["g"]).collect()}
    assert got == {"p": (4, 2, 0.5, 2.0), "q": (1, 1, 0.0, 1.0)}
    assert tuple(runs.duplication(df).first())[:2] == (5, 2)
    assert tuple(runs.duplication(df, approximate=True).first())[:2] == (5, 2)
    assert tuple(runs.duplication(df.limit(0)).first()) == (0, 0, 1.0, 0.0)
