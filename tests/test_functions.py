"""Column functions over tables of inputs and expected values; planted conflicts; lifecycle rules."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import columns as C
from factloom.functions.vocabulary import ATTRIBUTES, MULTIPLIERS, UNITS
from factloom.operators import conflicts, lifecycle, series

def grouped(n: int) -> str:
    """A number with Indian grouping: the last three digits, then pairs."""
    head, tail = str(n)[:-3], str(n)[-3:]
    pairs = []
    while head:
        head, pair = head[:-2], head[-2:]
        pairs.insert(0, pair)
    return ",".join([*pairs, tail])


def quantities():
    """Every unit and every number word with made numbers: text, value, unit."""
    rng = random.Random(11)
    for unit, (name, factor) in UNITS.items():
        n = rng.randrange(10_000, 90_000_000)
        for text, value in ((grouped(n), n), (f"{n // 100}.{n % 100:02}", n / 100)):
            yield f"{text} {unit}", value * factor, name
            yield f"some {text} {unit.upper()} of it", value * factor, name
        if not any(unit.startswith(w) for w in MULTIPLIERS):
            word, times = rng.choice([(w, t) for w, t in MULTIPLIERS.items() if f"{w} {unit}" not in UNITS])
            yield f"{n % 997}.5 {word} {unit}", (n % 997 + 0.5) * times * factor, name
    for word, times in MULTIPLIERS.items():
        yield f"about 7.25 {word}, then 9", 7.25 * times, None
    yield from [("from 64", 64.0, None), ("no number", None, None), ("16%ash", 16.0, "percent"), ("+3 km/h", 3.0, "km"), (None, None, None)]


def periods():
    """Texts with the start of the period that they name, for made dates of every month."""
    rng = random.Random(12)
    for m, name in enumerate(("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"), 1):
        y, d = rng.randrange(1951, 2049), rng.randrange(1, 29)
        iso = f"{y}-{m:02}-{d:02}"
        yield from [(f"stock of {d:02}/{m:02}/{y}", iso), (f"{d}-{m}-{y}", iso), (f"by {d}th {name} {y}", iso), (f"{d} {name[:3]}. {y} and 1950", iso), (f"the {y}s", f"{y}-01-01")]
        yield from [(f"{y}–{y + 1}", f"{y}-04-01"), (f"year {y} - {(y + 1) % 100:02}", f"{y}-04-01")]
        if y > 2000:
            yield from [(f"FY{y % 100:02} plan", f"{y - 1}-04-01"), (f"fy '{y % 100:02}", f"{y - 1}-04-01"), (f"FY {y}", f"{y - 1}-04-01")]
        yield f"31.3.{y}", f"{y - 1}-04-01"  # the last day of a fiscal year belongs to it
    yield from [("no period", None), ("30.02.2031", "2031-01-01"), ("12 lakh 1999", "1999-01-01"), (None, None)]


NOISE = ["", "  ", "NIL", "n/a", "—", "(14)", "1987", "FY 2031", "2044-45", "1961 – 1962", "7.8.2009", "1/2/34", "120-450", "1st half", "9 May", "-62", "0.25", "-0.5", "2.718281", "seventeen", "Rs 12 each", None]
NOT_NOISE = ["61", "7.25", "1,20,000", "12 km", "88 %", "3.5 lakh tonnes", "2.50000000", "1 a", "+7"]


def column(spark, rows, f):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string")
    return [r.x for r in df.select("i", f(F.col("s")).alias("x")).orderBy("i").collect()]


def test_quantities(spark):
    want = list(quantities())
    got = column(spark, [q[0] for q in want], C.parse_quantity)
    assert [(q[0], g.value is None or round(g.value, 6), g.unit) for q, g in zip(want, got)] == [(q[0], q[1] is None or round(q[1], 6), q[2]) for q in want]


def test_noise(spark):
    assert column(spark, NOISE + NOT_NOISE, C.is_noise) == [True] * len(NOISE) + [False] * len(NOT_NOISE)
    assert [x is None for x in column(spark, NOISE + NOT_NOISE, C.extract_value)] == [True] * len(NOISE) + [False] * len(NOT_NOISE)


def test_periods(spark):
    want = list(periods())
    assert list(zip([p[0] for p in want], column(spark, [p[0] for p in want], C.normalize_period))) == [(t, p and datetime.date.fromisoformat(p)) for t, p in want]


def test_labels(spark):
    assert column(spark, ["2041-04-01", "2041-01-01", None], lambda s: C.fy_label(s.cast("date"))) == ["FY2041-42", "2041", "-"]


def test_attributes(spark):
    """The keyword that stands last gives the attribute; among keywords that end together, the vocabulary's order."""
    words = [(name, w) for name, ws in ATTRIBUTES.items() for w in ws]
    plain = [(name, w) for name, w in words if not any(o != w and o in w for _, o in words)]
    texts = [f"{a.title()} before {b} here" for (_, a), (_, b) in zip(plain, plain[1:] + plain[:1])]
    assert column(spark, texts + ["nothing of it", None], C.detect_attribute) == [name for name, _ in plain[1:] + plain[:1]] + [None, None]


def test_context_units(spark):
    units = [u for u in UNITS if not any(o != u and o in u.split() for o in UNITS)]
    got = column(spark, [f"Figures ({u})" for u in units] + ["Name of place", "km, then lakh tonnes", None], C.context_unit)
    assert [tuple(x) for x in got[: len(units)]] == [UNITS[u] for u in units] and [tuple(x) for x in got[len(units) :]] == [(None, 1.0), ("tonnes", 1e5), (None, 1.0)]


def test_text_facts(spark):
    from factloom.operators.extraction import text_facts

    docs = spark.createDataFrame([
        (1, "Alpha Pit had a production of 5 lakh tonnes in 2031-32 and offtake of 4.5 lakh tonnes; ash 34 % in the previous year."), (2, "production of 7 km in 1999. production of 7 km again."),
        (3, "ash of 340 %, on 4 May 2001, in 1987, manpower 12"), (4, None), (5, ""),
    ], "doc_id long, text string")
    names = spark.createDataFrame([("Alpha Pit",), ("Alpha",)], "entity string")
    got = sorted((r.doc_id, r.attribute, r.value, r.unit, str(r.period), r.entity) for r in text_facts(docs, names).collect())
    assert got == [
        (1, "ash_pct", 34.0, "percent", "2030-04-01", "Alpha Pit"), (1, "offtake", 450000.0, "tonnes", "2031-04-01", "Alpha Pit"), (1, "production", 500000.0, "tonnes", "None", "Alpha Pit"),
        (2, "production", 7.0, "km", "None", None), (3, "manpower", 12.0, None, "2001-05-04", None),
    ]


def test_ranges(spark):
    df = spark.createDataFrame([("ash_pct", 34.0), ("ash_pct", 140.0), ("gcv", 5800.0), ("gcv", 50.0), ("production", 1e9)], "a string, v double")
    assert [r[0] for r in df.select(C.in_range(F.col("a"), F.col("v"))).collect()] == [True, False, True, False, True]


def test_recency(spark):
    df = spark.createDataFrame([("2031-01-01",), ("2032-06-01",), (None,)], "s string").select(C.recency(F.col("s").cast("date"), "2032-01-01").alias("r"))
    assert [round(r.r, 6) for r in df.collect()] == [0.367879, 1.0, 0.3]


def test_clean_text(spark):
    assert column(spark, ["produc-\ntion", "produc­tion", "a   b"], C.clean_text) == ["production", "production", "a b"]


FACTS = [
    ("North Pit", "production", "2031-04-01", 6.10e6, "d1"), ("North Pit", "production", "2031-04-01", 5.25e6, "d2"), ("West Works", "offtake", "2032-04-01", 88.0e5, "d1"),
    ("West Works", "offtake", "2032-04-01", 91.5e5, "d2"), ("East Works", "production", "2033-04-01", 71.3e5, "d1"), ("East Works", "production", "2033-04-01", 71.3e5, "d2"),
]


@pytest.fixture(scope="module")
def facts(spark):
    df = spark.createDataFrame(FACTS, "entity string, attribute string, p string, value_norm double, doc_id string")
    return df.select(F.md5(F.concat_ws("|", "entity", "doc_id")).alias("fact_id"), "entity", "attribute", F.col("p").cast("date").alias("period"), "value_norm", F.lit("tonnes").alias("unit"), "doc_id", F.lit(0.9).alias("conf"), F.lit(False).alias("low_conf"), F.lit(True).alias("is_current"))


def test_planted_conflicts(facts):
    assert {r.entity for r in conflicts.radar(facts).collect()} == {"North Pit", "West Works"}
    assert {r.entity for r in conflicts.beyond_tolerance(facts).collect()} == {"North Pit", "West Works"}


def test_coverage_gaps(spark):
    rows = [("a", 2001), ("a", 2004), ("a", 2005), ("b", 2010)]
    df = spark.createDataFrame([(e, "production", datetime.date(y, 4, 1), 1.0) for e, y in rows], "entity string, attribute string, period date, value double")
    assert {(r.entity, r.n_gaps, r.gaps) for r in series.coverage_gaps(df).collect()} == {("a", 2, "2002,2003"), ("b", 0, "")}


def test_short_series_have_no_forecast(facts):
    rows = series.forecast(series.median_series(facts)).collect()
    assert rows and all(r.status == "insufficient" and r.forecast is None for r in rows)


def test_register_twice_is_once(spark):
    docs = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "doc_id int, sha256 string")
    first = lifecycle.register(docs, docs.limit(0))
    assert [r.duplicate for r in first.orderBy("doc_id").collect()] == [False, True, False]
    again = lifecycle.register(docs, first)
    assert all(r.duplicate for r in again.collect())


def test_compare_treats_null_keys_as_equal(facts):
    null = facts.withColumn("period", F.lit(None).cast("date"))
    states = {r.state for r in lifecycle.compare_documents(null, "d1", "d2").collect()}
    assert states == {"changed", "same"}


def test_delimited_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date;Qty\n01.04.2022;5,5\nx\n")
    (tmp_path / "b.csv").write_text('A,B\n"1,2",3\n')
    got = {(r.path.rsplit("/", 1)[1], r.row_idx, r.col_idx): r.value for r in lifecycle.read_table_files(spark, str(tmp_path)).collect()}
    assert got["a.csv", 1, 1] == "5,5" and got["a.csv", 2, 0] == "x" and got["a.csv", 2, 1] == "" and got["b.csv", 1, 0] == "1,2" and got["b.csv", 1, 1] == "3"


def test_delimited_files_in_other_encodings(spark, tmp_path):
    for name, coding in (("mark.csv", "utf-8-sig"), ("wide.csv", "utf-16"), ("old.csv", "latin-1"), ("plain.csv", "utf-8")):
        (tmp_path / name).write_bytes("né;b\n1;ü".encode(coding))
    got = {(r.path.rsplit("/", 1)[1], r.row_idx, r.col_idx): r.value for r in lifecycle.read_table_files(spark, str(tmp_path)).collect()}
    assert got == {(n, i, j): v for n in ("mark.csv", "wide.csv", "old.csv", "plain.csv") for i, row in enumerate((("né", "b"), ("1", "ü"))) for j, v in enumerate(row)}


def test_streamed_ingest_keeps_failures_and_duplicates_apart(spark, tmp_path):
    from factloom.streaming.ingest import ingest

    for i, rows in enumerate(([(1, "a"), (2, "a"), (3, None)], [(4, "a"), (5, "b")])):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    known, dead, derived = ingest(spark, str(tmp_path / "in"), "doc_id long, text string", str(tmp_path / "out"), lambda b: b.select("doc_id"))
    assert known.select("sha256").count() == 2 and [r.doc_id for r in dead.collect()] == [3] and derived.count() == 2


def test_a_failed_batch_is_run_again_without_loss_or_repeats(spark, tmp_path):
    from factloom.streaming.ingest import ingest, ingest_batch

    schema = "doc_id long, text string"
    for rows in ([(1, "a"), (2, None)], [(3, "b"), (4, "a")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    root = str(tmp_path / "run")
    failing = [True]

    def build(fresh):
        out = fresh.select("doc_id", "text")
        if failing:
            failing.clear()
            return out.withColumn("text", F.raise_error(F.lit("lost")))  # fails while the derived rows are written, after dead letters
        return out

    with pytest.raises(Exception):
        ingest(spark, str(tmp_path / "in"), schema, str(tmp_path), build, root)
    known, dead, derived = ingest(spark, str(tmp_path / "in"), schema, str(tmp_path), build, root)
    assert sorted(r.text for r in derived.collect()) == ["a", "b"] and known.count() == 2 and [r.doc_id for r in dead.collect()] == [2]
    batch = spark.createDataFrame([(9, "z"), (10, None)], schema)
    for _ in range(2):
        ingest_batch(batch, 7, root, build)
    assert spark.read.parquet(f"{root}/derived").where("doc_id = 9").count() == spark.read.parquet(f"{root}/dead").where("doc_id = 10").count() == 1


def test_status_log_keeps_old_values_and_can_be_run_again(spark, tmp_path):
    from factloom.streaming.ingest import status_log

    schema = "k string, ts int, id int, status string, note string"
    for rows in ([("a", 1, 1, "open", "x"), ("b", 1, 2, "open", None)], [("a", 2, 3, "closed", None)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    root = str(tmp_path / "run")
    got = lambda: {tuple(r) for r in status_log(spark, str(tmp_path / "in"), schema, str(tmp_path), lambda b: b, "k", "ts", ["status", "note"], "id", root).collect()}
    assert got() == got() == {("a", 2, "closed", "x"), ("b", 1, "open", None)}


def test_late_events_are_dropped(spark, tmp_path):
    from factloom.streaming.ingest import event_counts

    days = ["2024-01-01 10:00:00", "2024-01-03 10:00:00", "2024-01-01 11:00:00"]
    for i, ts in enumerate(days):
        spark.createDataFrame([(ts, "k")], "t string, kind string").selectExpr("cast(t as timestamp) as ts", "kind").coalesce(1).write.parquet(str(tmp_path / "in" / f"part{i}"))
    stream = spark.readStream.schema("ts timestamp, kind string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "part*"))
    got = []
    q = event_counts(stream).writeStream.outputMode("append").foreachBatch(lambda b, n: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.start.day, r.n) for r in got] in ([(1, 1)], [(1, 2)])
