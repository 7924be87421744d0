import random

import pytest
from pyspark.sql import functions as F

from logfold.operators import folding, published, tables
from logfold.streaming import folds

ORDER = ["t", "id"]
SCHEMA = "sig string, t long, id long, message string"


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")  # a stream starts one Python worker for each
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    return [(rng.choice(["x", "x", "x", "x", "y", f"r{i % 40}"]), i // 2, i, f"m{i}") for i in range(900)]


def keyed(df):
    return {r["sig"]: tuple(r) for r in df.collect()}


def test_upsert_is_idempotent_and_split_invariant(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    parts = [df.where(F.col("id") % 3 == i) for i in range(3)]
    want = keyed(folding.last_records(df, ORDER))
    table = parts[0].limit(0)
    for part in (parts[2], parts[0], parts[1], parts[0]):
        table = tables.upsert(table, part, "sig", ORDER)
    assert keyed(table) == want


def test_deltas_compaction_and_settling(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, SCHEMA)
    source, target = str(tmp_path / "live"), str(tmp_path / "compact")
    for batch_id, half in enumerate((df.where("id < 450"), df.where("id >= 450"))):
        for _ in range(2):
            tables.write_batch(folding.last_records(half, ORDER), source, batch_id)
    schema = df.schema
    want = keyed(folding.last_records(df, ORDER))
    assert keyed(tables.read_latest(spark, source, schema, "sig").select("sig", "t", "id", "message")) == want
    before = tables.settle_check(spark, source, schema, "sig").first()
    assert before.docs == len(want) and before.superseded > 0 and not before.settled
    assert tables.compact_table(spark, source, target, schema, "sig") == 1
    after = tables.settle_check(spark, target, schema, "sig").first()
    assert (after.files, after.docs, after.superseded, after.settled) == (1, len(want), 0, True)
    assert keyed(tables.read_latest(spark, target, schema, "sig").select("sig", "t", "id", "message")) == want
    # sized by the rows that stay, without the superseded ones; a table of many files is settled too
    assert tables.compact_table(spark, source, str(tmp_path / "many"), schema, "sig", target_bytes=500) > 1
    assert tables.settle_check(spark, str(tmp_path / "many"), schema, "sig", target_bytes=500).first().settled
    assert tables.storage_stats(spark, str(tmp_path)).first().bytes > before.bytes


def test_append_table(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, SCHEMA)
    tables.append_records(df, str(tmp_path / "t"))
    tables.append_records(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2 * len(rows)


def feed(spark, rows, cuts, tmp_path, start):
    """Write the rows in time order in as many files as cuts say, one run and batch for each."""
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    edges = [0, *cuts, len(rows)]
    for low, high in zip(edges, edges[1:]):
        spark.createDataFrame(rows[low:high], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        start(stream, out, check).awaitTermination()
    return out, folds.document_schema(spark.createDataFrame([], SCHEMA))


@pytest.mark.parametrize("cuts", [[], [100, 500], [10, 11, 300, 310, 600]])
def test_stream_emissions_do_not_depend_on_batches(spark, rows, tmp_path, cuts):
    df = spark.createDataFrame(rows, SCHEMA)
    want = {r.id: r["count"] for r in folding.edge_emissions(df, ORDER, 0.1).collect()}
    out, schema = feed(spark, rows, cuts, tmp_path, lambda s, o, c: folds.fold_emissions(
        s, o, c, ORDER, 0.1))
    assert {r.id: r["count"] for r in folds.read_emitted(spark, out, schema).collect()} == want


@pytest.mark.parametrize("cuts", [[], [100, 500, 501]])
def test_stream_counts_equal_the_batch_fold(spark, rows, tmp_path, cuts):
    df = spark.createDataFrame(rows, SCHEMA)
    want = {r.sig: (r.id, r["count"]) for r in folding.index_documents(df, ORDER).collect()}
    out, schema = feed(spark, rows, cuts, tmp_path, lambda s, o, c: folds.fold_counts(s, o, c, ORDER))
    assert {r.sig: (r.id, r["count"]) for r in folds.read_documents(spark, out, schema).collect()} == want


def test_stream_bounded_counts(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, SCHEMA)
    want = {r.sig: r.stored for r in folding.edge_counts(df, 0.5).collect()}
    out, schema = feed(spark, rows, [100, 102, 500], tmp_path, lambda s, o, c: folds.fold_bounded(s, o, c, ORDER, 0.5))
    assert {r.sig: r["count"] for r in folds.read_documents(spark, out, schema).collect()} == want
    written = published.read_published(spark, out, schema).groupBy("batch").count().collect()
    counts = {r.batch: r["count"] for r in written}
    assert counts.get(1, 0) == 0 and counts[2] > 0


@pytest.mark.parametrize("fold,want_of", [
    (folds.fold_counts, lambda df: {r.sig: (r.id, r["count"]) for r in folding.index_documents(df, ORDER).collect()}),
    (lambda *a, **b: folds.fold_bounded(*a, 0.5, **b), lambda df: {r.sig: r.stored for r in folding.edge_counts(df, 0.5).collect()})])
def test_table_is_merged_while_it_is_written_and_read(spark, rows, tmp_path, monkeypatch, fold, want_of):
    """A reader beside the stream sees whole batches only, and what it has opened stays readable through a merge."""
    schema = folds.document_schema(spark.createDataFrame([], SCHEMA))
    seen, held, swap = [], [], published._swap_pointer

    def watched(session, path, state):
        seen.append(folds.read_documents(spark, path, schema).count())
        held.append((folds.read_documents(spark, path, schema), seen[-1]))
        swap(session, path, state)
        seen.append(folds.read_documents(spark, path, schema).count())

    monkeypatch.setattr(published, "_swap_pointer", watched)
    out, _ = feed(spark, rows, [5, 60, 200, 500, 501, 700], tmp_path, lambda s, o, c: fold(s, o, c, ORDER, merge_every=2))
    assert len(seen) == 14 and seen == sorted(seen)
    assert [frame.count() for frame, _ in held] == [n for _, n in held]
    folders = published.live_folders(spark, out)
    assert len(folders) < 7 and any("merged-" in f for f in folders)
    found = folds.read_documents(spark, out, schema).collect()
    want = want_of(spark.createDataFrame(rows, SCHEMA))
    assert {r.sig: (r.id, r["count"]) if isinstance(want[r.sig], tuple) else r["count"] for r in found} == want


def test_replaced_folders_go_after_a_while(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k long, v long"
    for batch_id in range(9):
        for _ in range(2 if batch_id == 4 else 1):  # one batch is written twice
            frame = spark.range(batch_id, batch_id + 3).selectExpr("id AS k", f"{batch_id} * 10L AS v")
            published.publish_batch(frame, path, batch_id, "k", merge_every=3, keep=2)
    rows = published.read_current(spark, path, frame.schema, "k").collect()
    assert {r.k: r.v for r in rows} == {k: min(k, 8) * 10 for k in range(11)}
    on_disk = {p.name for p in (tmp_path / "t").iterdir() if p.is_dir()}
    assert len(on_disk) < 9 and {f.rsplit("/", 1)[1] for f in published.live_folders(spark, path)} <= on_disk
    assert published.read_current(spark, str(tmp_path / "none"), frame.schema, "k").count() == 0


def test_state_reads_do_not_grow_with_the_stream(spark, tmp_path):
    """Thirty batches of equal make: the last read as little state as the tenth, though the table has grown."""
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for k in range(30):
        values = [(f"s{j}" if j < 20 else f"new{k}-{j}", k, 100 * k + j, "m") for j in range(40)]
        spark.createDataFrame(values, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    query = folds.fold_emissions(stream, out, check, ORDER, 0.1)
    query.awaitTermination()
    steps = [p for p in query.recentProgress if p["numInputRows"]]
    assert len(steps) == 30
    reads = [p["stateOperators"][0]["customMetrics"]["rocksdbGetCount"] for p in steps]
    assert max(reads[20:]) <= 1.2 * max(reads[5:12])
    rows = spark.read.schema(SCHEMA).parquet(source)
    want = {r.id: r["count"] for r in folding.edge_emissions(rows, ORDER, 0.1).collect()}
    assert {r.id: r["count"] for r in folds.read_emitted(spark, out, folds.document_schema(rows)).collect()} == want


def test_repeated_batch_changes_nothing(spark, rows, tmp_path):
    """A batch whose commit was lost runs again with the same id."""
    out, schema = feed(spark, rows, [400], tmp_path, lambda s, o, c: folds.fold_emissions(s, o, c, ORDER, 0.1))
    before = sorted(map(tuple, folds.read_emitted(spark, out, schema).collect()))
    (tmp_path / "check" / "commits" / "1").unlink()
    (tmp_path / "check" / "commits" / ".1.crc").unlink(missing_ok=True)
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    folds.fold_emissions(stream, out, str(tmp_path / "check"), ORDER, 0.1).awaitTermination()
    assert sorted(map(tuple, folds.read_emitted(spark, out, schema).collect())) == before


def test_append_stream(spark, rows, tmp_path):
    out, _ = feed(spark, rows, [300], tmp_path, lambda s, o, c: folds.append_stream(s, o, c))
    assert spark.read.parquet(out).count() == len(rows)


def test_bucketed_upsert_shuffles_the_batch_once(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, SCHEMA)
    first, second = df.where("id < 500"), df.where("id >= 300 AND id % 3 > 0")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = str(tmp_path / "snapshot")
    snapshot = tables.write_bucketed(folding.last_records(first, ORDER), path, "sig", buckets)
    want = keyed(folding.last_records(first.unionByName(second), ORDER))
    opened = tables.open_bucketed(spark, path, snapshot.schema, "sig", buckets)
    for table in (snapshot, opened):
        upserted = tables.upsert_bucketed(table, second, "sig", ORDER)
        plan = upserted._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Exchange") == 1
        assert keyed(upserted.select("sig", "t", "id", "message")) == want
    again = tables.write_bucketed(upserted, str(tmp_path / "next"), "sig", buckets)
    assert keyed(tables.upsert_bucketed(again, second, "sig", ORDER).select("sig", "t", "id", "message")) == want
    with pytest.raises(Exception, match="upsert is NULL"):
        tables.upsert_bucketed(again, spark.createDataFrame([(None, 1, 1, "m")], SCHEMA), "sig", ORDER).collect()


def test_runs_are_measured_from_what_is_stored(spark, rows, tmp_path):
    """Counts, documents and settledness follow the files: a superseded document unsettles its workload and no other."""
    from logfold.plans import measured, metrics, runs
    log = spark.createDataFrame(rows, SCHEMA).withColumn("workload_id", F.col("id") % 3).withColumn("bytes", F.lit(10).cast("long"))
    root = str(tmp_path / "strategies")
    measured.store_strategies(log, root, ORDER, 0.5)
    key = ["pipeline", "workload_id", "dup_ratio", "N", "M", "reconstructed", "forwarded"]
    sorted_rows = lambda df: sorted(map(tuple, df.select(*key).collect()))
    found = measured.measure_runs(spark, root, 0.5)
    assert sorted_rows(found) == sorted_rows(runs.evaluate_strategies(log, eps=0.5))
    assert all(r.settled and r.storage > 0 for r in found.collect())
    # what B keeps is the record it emitted last
    emitted = folding.edge_emissions(log.where("workload_id = 1"), ORDER, 0.5)
    want = {r.sig: (r.id, r["count"]) for r in folding.last_records(emitted, ["count"]).collect()}
    assert {r.sig: (r.id, r["count"]) for r in spark.read.parquet(f"{root}/B").where("workload_id = 1").collect()} == want
    stored = spark.read.parquet(f"{root}/C").where("workload_id = 2").limit(1)
    materialized = spark.createDataFrame(stored.collect(), stored.schema)
    materialized.write.mode("append").partitionBy("workload_id").parquet(f"{root}/C")
    later = {(r.pipeline, r.workload_id): r for r in measured.measure_runs(spark, root, 0.5).collect()}
    assert [k for k, r in later.items() if not r.settled] == [("C", 2)] and later["C", 2].M == {(r.pipeline, r.workload_id): r.M for r in found.collect()}["C", 2]
    flagged = metrics.run_metrics(measured.measure_runs(spark, root, 0.5)).where("NOT storage_valid").select("pipeline", "workload_id").collect()
    assert ("C", 2) in {tuple(r) for r in flagged}


def test_sketches_of_parts_merge_to_the_whole(spark, tmp_path):
    from logfold.plans import sketches
    path = str(tmp_path / "sketches")
    for day in range(4):  # each day shows new and known signatures
        sketches.store_sketches(spark.range(day * 3000, day * 3000 + 9000).selectExpr(f"{day} AS day", "concat('s', id) AS sig"), path, ["day"])
    whole = sketches.estimated_duplication(spark, path).first()
    assert whole.N == 36_000 and abs(whole.U - 18_000) < 360
    assert all(abs(r.U - 9000) < 180 for r in sketches.estimated_duplication(spark, path, ["day"]).collect())
