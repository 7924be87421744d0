import json
import os

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from logfold.functions.masking import with_signature
from logfold.operators import shaping
from logfold.sources import files
from logfold.streaming import folds

EVENT = {"level": "INFO", "component": "info", "message": "User ab logged in from 10.1.2.3"}


def write(path, lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")


def test_json_logs_keep_bad_lines(spark, tmp_path):
    write(tmp_path / "a.json", [json.dumps(EVENT), "not json", json.dumps({"level": "WARN", "extra": 1})])
    rows = files.read_json_logs(spark, str(tmp_path)).orderBy("_corrupt", "level").collect()
    assert [(r.level, r._corrupt) for r in rows] == [("INFO", None), ("WARN", None), (None, "not json")]
    assert with_signature(files.read_json_logs(spark, str(tmp_path))).where("level = 'INFO'").first().sig == \
        "INFO|info|User ab logged in from {IP}"


def test_cri_logs(spark, tmp_path):
    name = "log-workload-ab12_default_emitter-0123abcd.log"
    write(tmp_path / name, [
        "2025-01-01T00:00:00.123456789Z stdout F " + json.dumps(EVENT),
        "2025-01-01T01:00:00.5+01:00 stderr P  two  blanks", "2025-01-01T00:00:00Z stdout F ",
        "2025-01-01T00:00:00Z stdin F no", "garbage", "2025-01-01T00:00:00Z stdout F " + "x" * 500])
    write(tmp_path / "other.txt", ["2025-01-01T00:00:00Z stdout F skipped"])
    logs = files.read_cri_logs(spark, str(tmp_path), files.WORKLOAD_GLOB, 400)
    every = logs.select(F.unix_micros("time").alias("us"), "stream", "logtag", "log", "tag", "kubernetes", "parsed").collect()
    assert [(r.us, r.stream, r.logtag, r.log) for r in every if not r.parsed] == [
        (None, None, None, "2025-01-01T00:00:00Z stdin F no"), (None, None, None, "garbage")]
    rows = [r for r in every if r.parsed]
    assert [(r.us - 1735689600000000, r.stream, r.logtag, r.log) for r in rows] == [
        (123456, "stdout", "F", json.dumps(EVENT)), (500000, "stderr", "P", " two  blanks"), (0, "stdout", "F", "")]
    assert rows[0].tag.startswith("kube.") and rows[0].tag.endswith("." + name)
    assert rows[0].kubernetes.asDict() == {"pod_name": "log-workload-ab12", "namespace_name": "default",
                                           "container_name": "emitter", "container_id": "0123abcd"}
    merged = shaping.lift(shaping.merge_json(logs.where("parsed"), "log", files.EVENT_SCHEMA), "kubernetes", "k8s_")
    rows = merged.orderBy(F.desc("component"), F.desc("message")).collect()
    assert (rows[0].message, rows[0].component, rows[0].k8s_pod_name) == (EVENT["message"], "info", "log-workload-ab12")
    assert (rows[1].message, rows[1].level) == (" two  blanks", None)
    assert "log" not in merged.columns


def test_merge_json_edge_cases(spark):
    schema = StructType([StructField("message", StringType()), StructField("n", LongType())])
    df = spark.createDataFrame([('{"message":"m","n":1}', 9), ('{"n":2}', 8), ("[1]", 7), ("12", 6), ("", 5), (None, 4)],
                               "log string, n long")
    got = [(r.message, r.n) for r in shaping.merge_json(df, "log", schema).collect()]
    assert got == [("m", 1), (None, 2), ("[1]", 7), ("12", 6), ("", 5), (None, 4)]
    assert "log" in shaping.merge_json(df, "log", schema, keep=True).columns


def test_merge_json_loses_nothing(spark):
    schema = StructType([StructField("message", StringType()), StructField("n", LongType())])
    df = spark.createDataFrame([('{"message":"m","n":"abc","x":{"y":1}}',), ('{"n":3}',)], "log string")
    rows = shaping.merge_json(df, "log", schema).collect()
    assert [tuple(r) for r in rows] == [("m", None, '{"n":"abc","x":"{\\"y\\":1}"}'), (None, 3, None)]


def test_docker_line_that_does_not_parse(spark, tmp_path):
    write(tmp_path / "a.log", ["not json", json.dumps({"time": "2025-01-01T00:00:00", "log": "m"})])
    rows = files.read_docker_logs(spark, str(tmp_path)).collect()
    assert sorted((r.log or "", r._corrupt or "") for r in rows) == [("", "not json"), ("m", "")]


def test_runs_keep_large_whole_numbers(spark, tmp_path):
    write(tmp_path / "runs.csv", ["pipeline,workload_id,seed,N,M", "A,1,9007199254740993,9007199254740993,2.0"])
    row = files.read_runs(spark, str(tmp_path)).first()
    assert (row.seed, row.N, row.M) == (9007199254740993, 9007199254740993, 2)


def test_docker_logs(spark, tmp_path):
    write(tmp_path / "a.log", [json.dumps({"time": "2025-01-01T00:00:00.250", "log": "l", "stream": "stdout"}),
                               json.dumps({"time": "2025-01-01T02:00:00.250+02:00", "log": "m"})])
    rows = files.read_docker_logs(spark, str(tmp_path)).select(F.unix_millis("time").alias("ms"), "log").collect()
    assert [(r.ms, r.log) for r in rows] == [(1735689600250, "l"), (1735689600250, "m")]


def test_lift_without_struct(spark):
    df = spark.createDataFrame([("a",)], "log string")
    assert shaping.lift(df, "log", "log_").columns == ["log"]
    assert shaping.lift(df, "absent", "x_").columns == ["log"]


def test_route_treats_only_stars_as_wild(spark):
    df = spark.createDataFrame([("kube.a",), ("kubeXa",), ("other",), ("kube.50%_b",)], "tag string")
    assert [r.tag for r in shaping.route(df, "kube.*").collect()] == ["kube.a", "kube.50%_b"]
    assert [r.tag for r in shaping.route(df, "*50%_*").collect()] == ["kube.50%_b"]


def test_run_tables_with_and_without_optional_columns(spark, tmp_path):
    os.makedirs(tmp_path / "old")
    write(tmp_path / "full.csv", [
        "pipeline,workload_id,dup_ratio,seed,N,M,storage,total_storage,reconstructed,failed,settled,timestamp",
        "A,1,0.5,42,100,100,1000,1000,100,false, False ,20250101_000000",
        "B,1,0.5,42,100,50,900,900,99.0,fb,true,20250101_000100"])
    write(tmp_path / "old" / "old.csv", ["pipeline,workload_id,dup_ratio,N,M,storage", "A,1,0.5,100,100,1000"])
    full = files.read_runs(spark, str(tmp_path / "full.csv")).orderBy("pipeline").collect()
    assert [(r.settled, r.reconstructed, r.failed) for r in full] == [(False, 100, "false"), (True, 99, "fb")]
    old = files.read_runs(spark, str(tmp_path / "old" / "old.csv"))
    assert old.schema == files.RUN_SCHEMA
    assert (old.first().settled, old.first().reconstructed, old.first().M) == (None, None, 100)


def test_run_tables_of_several_headers_are_read_by_name(spark, tmp_path):
    write(tmp_path / "a.csv", ["pipeline,workload_id,N,M", "A,1,100,90"])
    write(tmp_path / "b.csv", ["M,N,pipeline,workload_id,settled", "50,100,B,2, FALSE ", ",7.0,C,3,"])
    rows = {r.pipeline: (r.workload_id, r.N, r.M, r.settled) for r in files.read_runs(spark, str(tmp_path)).collect()}
    assert rows == {"A": (1, 100, 90, None), "B": (2, 100, 50, False), "C": (3, 7, None, None)}


def test_analysis_without_failures_and_its_export(spark, tmp_path):
    from logfold.plans import analysis
    (tmp_path / "runs").mkdir()
    write(tmp_path / "runs" / "r.csv", ["pipeline,workload_id,dup_ratio,N,M,storage", "A,1,0.5,100,100,1000", "B,1,0.5,100,50,600", "B,2,0.9,100,10,9000"])
    tables = analysis.analyze_runs(spark, str(tmp_path / "runs"))
    assert "tradeoff" not in tables and all(r.IPR_Failure is None for r in tables["comparison"].collect())
    assert [(r.label, r.excluded, r.runs) for r in tables["exclusions"].collect()] == [("wl2(2.0x)", 1, 2)] or tables["exclusions"].count() == 1
    analysis.export(tables, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "metrics")).count() == 3


def test_csv_export(spark, tmp_path):
    files.write_csv(spark.createDataFrame([("A", 1)], "Pipeline string, n long"), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first().asDict() == {"Pipeline": "A", "n": "1"}
    assert len([n for n in os.listdir(tmp_path / "out") if n.endswith(".csv")]) == 1


def test_stream_of_container_logs_resumes(spark, tmp_path):
    source, out, check = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "check")
    source.mkdir()

    def line(i, message):
        record = dict(EVENT, message=message)
        return f"2025-01-01T00:00:{i:02d}Z stdout F {json.dumps(record)}"

    def run():
        logs = files.stream_logs(spark, str(source), files_per_trigger=1)
        signed = with_signature(shaping.merge_json(logs, "log", files.EVENT_SCHEMA)).select(
            "sig", F.unix_micros("time").alias("us"), "message")
        folds.fold_counts(signed, out, check, ["us"]).awaitTermination()
        rows = folds.read_documents(spark, out, folds.document_schema(signed)).collect()
        return {r._agg_id: (r["count"], r.message) for r in rows}

    name = "log-workload-{}_default_emitter-0a.log"
    write(source / name.format(1), [line(1, "a 1"), line(2, "a 2"), line(3, "b")])
    write(source / "unrelated.log", [line(1, "a 1")])
    assert run() == {"INFO|info|a {NUM}": (2, "a 2"), "INFO|info|b": (1, "b")}
    write(source / name.format(2), [line(5, "a 5")])
    write(source / name.format(3), [line(4, "a 4"), line(6, "c")])
    assert run() == {"INFO|info|a {NUM}": (4, "a 5"), "INFO|info|b": (1, "b"), "INFO|info|c": (1, "c")}
    assert run()["INFO|info|a {NUM}"] == (4, "a 5")
