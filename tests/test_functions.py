import math
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logfold.functions import masking as K
from logfold.functions import scalars as S
from logfold.functions.schedule import emission_counts, emissions_until, last_emitted

MASKED = [
    ("id 550e8400-e29b-41d4-a716-446655440000 ok", "id {UUID} ok"),
    ("id 550E8400-E29B-41D4-A716-446655440000", "id {UUID}"),
    ("from 10.0.0.1:80", "from {IP}:{NUM}"),
    ("999.999.999.999", "{IP}"),
    ("1.2.3", "{NUM}.{NUM}.{NUM}"),
    ("1.2.3.4.5", "{IP}.{NUM}"),
    ("1.2.3.4.5.6.7.8", "{IP}.{IP}"),
    ("a1.2.3.4b", "a{IP}b"),
    ("a1b22", "a{NUM}b{NUM}"),
    ('said "x 5" twice', "said {STR} twice"),
    ('""', "{STR}"),
    ('open " quote', 'open " quote'),
    ('"a" "b', '{STR} "b'),
    ('over "two\nlines"', "over {STR}"),
    ("-5 and 1e9", "-{NUM} and {NUM}e{NUM}"),
    ('{"k": 69}', "{{STR}: {NUM}}"),
    ("Größe ٣ 7", "Größe ٣ {NUM}"),
    ("", ""),
]


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def values(df, expression):
    return [row[0] for row in df.select(expression).collect()]


def test_masking_cases(spark):
    df = column(spark, [m for m, _ in MASKED])
    assert values(df, K.normalize(F.col("v"))) == [w for _, w in MASKED]


def test_masking_of_a_long_digit_run_is_fast(spark):
    df = column(spark, ["7" * 2_000_000 + ".1"])
    assert values(df, K.normalize(F.col("v"))) == ["{NUM}.{NUM}"]


def test_user_rules_and_special_tokens(spark):
    rules = [(r"user-\w+", "<$user\\>", "user-"), ("[0-9]+", "#", "")]
    assert values(column(spark, ["user-ab 12", "x 3"]), K.normalize(F.col("v"), rules)) == ["<$user\\> #", "x #"]


def test_signature_defaults_and_prefixed_names(spark):
    df = spark.createDataFrame(
        [("E", None, None, "m 1"), (None, "W", "c", None), ("", None, None, "")],
        "level string, log_level string, component string, log_message string")
    signed = K.with_signature(df)
    assert [r.sig for r in signed.collect()] == ["E|unknown|m {NUM}", "W|c|", "|unknown|"]
    tagged = K.tag_record(signed, "sig", F.lit(3)).first()
    assert (tagged._agg_id, tagged["count"], tagged.aggregated) == ("E|unknown|m {NUM}", 3, True)


def test_letters(spark):
    def token(i):
        out, i = "", i + 1
        while i:
            i, rest = divmod(i - 1, 26)
            out = chr(97 + rest) + out
        return out

    numbers = [0, 25, 26, 27, 51, 52, 701, 702, 18277, 18278, 475253, 475254, 26 ** 6, 321272406, 12356630, 10 ** 12, 2 ** 62, 2 ** 63 - 1]
    assert values(column(spark, numbers, "long"), S.letters("v")) == [token(n) for n in numbers]


def test_categories_at_their_bounds(spark):
    df = column(spark, [0.0, 0.3, 0.31, 0.7, 0.71, None], "double")
    assert values(df, S.category(F.col("v"))) == ["low", "low", "med", "med", "high", None]


def test_count_or_zero(spark):
    df = column(spark, ["12", "", "-1", "1.5", "x", None, "99999999999999999999"])
    assert values(df, S.count_or_zero(F.col("v"))) == [12, 0, 0, 0, 0, 0, 0]


def test_reconstructed_or_docs(spark):
    df = spark.createDataFrame([(0.0, 7), (None, 7), (3.9, 7), (0.5, 7)], "r double, m long")
    assert values(df, S.reconstructed_or_docs(F.col("r"), F.col("m"))) == [7, 7, 3, 7]


def test_json_number(spark):
    df = column(spark, ['{"a":{"b":{"value":12.0}}}', '{"a":1}', "", None])
    assert values(df, S.json_number(F.col("v"), "$.a.b.value")) == [12.0, 0.0, 0.0, 0.0]


def test_settled_flag(spark):
    df = column(spark, ["true", " False ", "FALSE", "no", "", None])
    assert values(df, S.is_settled(F.col("v"))) == [True, False, False, True, True, True]


def test_ratios(spark):
    df = spark.createDataFrame([(10, 4, 11), (10, 0, 0), (0, 0, 0)], "n long, m long, r long")
    assert values(df, S.ratio_or_zero(F.col("n"), F.col("m"))) == [2.5, 0.0, 0.0]
    assert values(df, S.preserved(F.col("r"), F.col("n"))) == [1.0, 0.0, 0.0]
    assert values(df, S.bytes_per_doc(F.col("n"), F.col("m"))) == [2.5, None, None]


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles"])
def test_micros_do_not_depend_on_the_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.sql("""SELECT * FROM VALUES (timestamp_ntz'2024-03-10 02:30:00.123456'),
            (timestamp_ntz'1969-12-31 23:59:59.9'), (timestamp_ntz'1970-01-01 00:00:00') AS t(v)""")
        numbers = values(df, S.micros("v"))
        assert numbers == [1710037800123456, -100000, 0]
        back = column(spark, numbers, "long").select(S.plus_micros("1970-01-01 00:00:00", F.col("v")).alias("v"))
        assert back.collect() == df.collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_power_index(spark):
    df = column(spark, [0.0, 0.5, 0.999999999], "double")
    assert values(df, S.power_index(F.col("v"), 100, 2.0)) == [0, 25, 99]


def simulate(n, eps):
    """Counts at which one signature is emitted, counted record by record."""
    emitted, last = [], None
    for count in range(1, n + 1):
        if last is None or count >= last * (1 + eps):
            last = count
            emitted.append(count)
    return emitted


@pytest.mark.parametrize("eps", [0.02, 0.1, 0.5, 1.0, 0.001])
def test_schedule_equals_simulation(eps):
    assert list(emission_counts(eps, 20000)) == simulate(20000, eps)


@settings(max_examples=25, deadline=None)
@given(st.floats(0.005, 2.0), st.integers(1, 3000))
def test_schedule_property(eps, n):
    assert [e for e in emission_counts(eps, 10 ** 6) if e <= n] == simulate(n, eps)


@pytest.mark.parametrize("eps", [0.02, 0.5, 3.0])
def test_lookup_equals_schedule(spark, eps):
    ns = list(range(0, 400)) + [10 ** 6, 10 ** 9 + 7, 10 ** 14]
    schedule = emission_counts(eps)
    got = column(spark, ns, "long").select(emissions_until("v", eps), last_emitted("v", eps)).collect()
    for n, (sent, stored) in zip(ns, got):
        upto = [e for e in schedule if e <= n]
        assert (sent, stored) == (len(upto), upto[-1] if upto else 0)


def test_loss_bound():
    schedule = emission_counts(0.02, 200000)
    worst = min(e / (following - 1) for e, following in zip(schedule, schedule[1:]))
    assert worst >= 1 / 1.02 - 1e-12
    assert schedule[:51] == tuple(range(1, 52))


def test_no_schedule_without_growth(spark):
    with pytest.raises(ValueError):
        emission_counts(0.0)
    assert values(column(spark, [5], "long"), last_emitted("v", 0.0)) == [5]
    with pytest.raises(ValueError):
        emission_counts(1e-9)
    assert math.isclose(len(emission_counts(1e-9, 1000)), 1000)


def test_many_masking_rules_plan_quickly(spark):
    rules = [(f"word{k}", "{W}", f"ord{k}") for k in range(30)] + [(r"\{W\}!", "{E}", "{W}")]
    df = spark.createDataFrame([("word3 word29 word7! else",)], "message string")
    start = time.time()
    assert K.with_template(df, F.col("message"), rules).first().template == "{W} {W}9 {E} else"
    assert time.time() - start < 20
