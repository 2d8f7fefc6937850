"""Day-partitioned partials: loads, late rows, repeated loads, exact bitmaps, sketch error."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from paths import SF01
from wattline.operators import panel as P
from wattline.operators import partials as PA
from wattline.operators import profiles as PR
from wattline.sources import tables as T

READING = "client_id long, datetime_local timestamp_ntz, community_code string, active_kw double"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def near(rows, digits=9):
    return sorted(tuple(round(v, digits) if isinstance(v, float) else v for v in r) for r in rows)


def some(spark, n=3000, seed=1, clients=(1, 2, 7, 32768, 32769, 32770, 70000, 1 << 40), days=6):
    rnd = random.Random(seed)
    base = dt.datetime(2024, 3, 1)
    rows = [(rnd.choice(clients), base + dt.timedelta(minutes=rnd.randrange(days * 1440)), rnd.choice("AABC"), rnd.choice([None, float(rnd.randrange(100)) / 4])) for _ in range(n)]
    rows += [(None, base, "A", 5.0), (1, None, "A", 5.0), (0, base, "B", 1.0), (-3, base, "B", 1.0)]
    return spark.createDataFrame(rows, READING)


def test_counts_are_exact_at_bucket_edges_and_for_null_clients(spark, tmp_path):
    r = some(spark)
    store = PA.DayStore(spark, str(tmp_path / "s"))
    store.load(PA.slot_partials(r), "a", "datetime_15min")
    dim = spark.createDataFrame([("A", "x"), ("B", "x")], "community_code string, region_group string")  # C has no group
    for grain in ("national", "region", "group"):
        assert near(PA.load_from(store.read(), grain, dim).collect()) == near(P.load_by(r, grain, dim).select("item_id", "datetime_15min", "active_kw", "n_clients", "avg_kw_per_client").collect())
    got = {tuple(x) for x in PA.all_grains_from(store.read(), dim).where("grain != 'group' or item_id is not null").select("grain", "item_id", "datetime_15min", "n_clients").collect()}
    assert got == {tuple(x) for x in P.load_all_grains(r, dim).where("grain != 'group' or item_id is not null").select("grain", "item_id", "datetime_15min", "n_clients").collect()}
    hourly = PA.roll_up(store.read(), {"hour": F.date_trunc("hour", "datetime_15min")}).agg(F.sum("n_clients")).first()[0]
    assert hourly == r.where("datetime_local is not null").groupBy(F.date_trunc("hour", "datetime_local")).agg(F.countDistinct("client_id").alias("n")).agg(F.sum("n")).first()[0]


def test_one_scan_of_the_readings(spark):
    readings = T.readings(spark, SF01)
    assert plan(PA.slot_partials(readings)).count("events.parquet") == plan(readings).count("events.parquet") == 1


def test_two_loads_equal_one_and_a_repeated_load_counts_once(spark, tmp_path):
    r = some(spark)
    late = F.col("client_id") == 7
    old = (F.col("datetime_local") < F.lit("2024-03-04").cast("timestamp_ntz")) & ~late
    first, second = r.where(old), r.where(~old | old.isNull())
    one, two = PA.DayStore(spark, str(tmp_path / "one")), PA.DayStore(spark, str(tmp_path / "two"))
    one.load(PA.slot_partials(r), "all", "datetime_15min")
    for load, batch in (("a", first), ("b", second), ("b", second)):
        two.load(PA.slot_partials(batch), load, "datetime_15min")
    want = near(PA.load_from(one.read()).collect())
    assert near(PA.load_from(two.read()).collect()) == want
    packed = PA.DayStore(spark, str(tmp_path / "packed"))
    two.compact(packed, PA.merge_slots, "datetime_15min")
    assert near(PA.load_from(packed.read()).collect()) == want
    assert packed.read().groupBy(*PA.SLOT_KEYS).count().where("count > 1").count() == 0
    assert {x["load_id"] for x in packed.loads().collect()} == {"compacted"}


def test_a_load_touches_its_own_days_only(spark, tmp_path):
    r = some(spark)
    path = str(tmp_path / "s")
    store = PA.DayStore(spark, path)
    store.load(PA.slot_partials(r.where("datetime_local < '2024-03-05'")), "a", "datetime_15min")
    seen = {os.path.join(a, f): os.stat(os.path.join(a, f)).st_mtime_ns for a, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    store.load(PA.slot_partials(r.where("datetime_local >= '2024-03-05' or (client_id = 2 and datetime_local < '2024-03-02')")), "b", "datetime_15min")
    assert all(os.path.exists(f) and os.stat(f).st_mtime_ns == t for f, t in seen.items())
    assert {(str(x["day"]), x["load_id"]) for x in store.loads().collect()} >= {("2024-03-01", "a"), ("2024-03-01", "b"), ("2024-03-05", "b")}
    assert ("2024-03-03", "b") not in {(str(x["day"]), x["load_id"]) for x in store.loads().collect()}
    assert "PartitionFilters: [isnotnull(day" in plan(store.read("2024-03-02", "2024-03-04"))


def test_profiles_merge_over_days(spark, tmp_path):
    r = some(spark)
    store = PA.DayStore(spark, str(tmp_path / "p"))
    store.load(PA.daily_profiles(r.where("client_id % 2 = 0")), "a", "client_id")
    store.load(PA.daily_profiles(r.where("client_id % 2 != 0 or client_id is null")), "b", "client_id")
    cols = [*PA.PROFILE_KEYS, "sum_kw", "sumsq_kw", "max_kw", "n", "avg_kw", "m2_kw"]
    want = PR.profile_partials(r.where("datetime_local is not null")).select(*cols)
    assert near([[str(v) for v in x[:5]] + [x[5] or 0.0, x[6] or 0.0, x[7], x[8] or 0.0, x[9] or 0.0] for x in PA.merge_profiles(store.read()).select(*cols).collect()], 6) == \
        near([[str(v) for v in x[:5]] + [x[5] or 0.0, x[6] or 0.0, x[7], x[8] or 0.0, x[9] or 0.0] for x in want.collect()], 6)


def test_numbers_have_no_gaps_and_stay(spark):
    names = spark.createDataFrame([(f"c{i % 700}",) for i in range(2000)] + [(None,)], "client_id string")
    known = PA.number_clients(names)
    assert sorted(r["client_no"] for r in known.collect()) == list(range(1, 701))
    more = PA.number_clients(spark.createDataFrame([("c5",), ("new",), ("a new one",)], "client_id string"), known)
    was = {r["client_id"]: r["client_no"] for r in known.collect()}
    now = {r["client_id"]: r["client_no"] for r in more.collect()}
    assert all(now[c] == n for c, n in was.items()) and {now["new"], now["a new one"]} == {701, 702}
    r = some(spark).withColumn("client_id", F.concat(F.lit("c"), F.abs("client_id") % 700))
    got = PA.load_from(PA.slot_partials(r, known)).agg(F.sum("n_clients")).first()[0]
    assert got == P.load_by(r, "region").agg(F.sum("n_clients")).first()[0]


def test_sketch_rank_error(spark, tmp_path):
    """The stored sketches' p95 lies within their rank error of the exact one, for heavy clients and two windows."""
    r = spark.range(60_000).select((F.col("id") % 3).alias("client_id"), (F.lit("2024-03-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("id") % 8640).cast("int"))).alias("datetime_local"),
                                   F.lit("A").alias("community_code"), (F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / 1000.0).alias("active_kw"))
    store = PA.DayStore(spark, str(tmp_path / "k"))
    store.load(PA.daily_sketches(r.where("client_id < 2 or datetime_local < '2024-03-03'")), "a", "client_id")
    store.load(PA.daily_sketches(r.where("client_id = 2 and datetime_local >= '2024-03-03'")), "b", "client_id")
    for a, b in (("2024-03-01", "2024-03-07"), ("2024-03-02", "2024-03-04")):
        part = r.where(F.col("datetime_local").between(a, dt.datetime.fromisoformat(b) - dt.timedelta(microseconds=1)))
        exact = {x["client_id"]: x["p95_kw"] for x in PR.client_p95_exact(r, a, b).collect()}
        for x in PA.p95_from(store.read(a, b)).collect():
            mine = part.where(F.col("client_id") == x["client_id"])
            n = mine.count()
            rank = mine.where(F.col("active_kw") <= x["p95_kw"]).count() / n
            assert x["n"] == n and abs(rank - 0.95) < 0.02, (x, rank, exact)
    merged = PA.merge_sketches(store.read())
    assert merged.count() == r.select("client_id", F.to_date("datetime_local")).distinct().count()


def test_empty_loads_and_left_out_loads(spark, tmp_path):
    r = some(spark, 200)
    none = r.limit(0)
    for name, make, key, merged in (("s", PA.slot_partials, "datetime_15min", PA.load_from), ("p", PA.daily_profiles, "client_id", PA.merge_profiles),
                                    ("k", PA.daily_sketches, "client_id", PA.p95_from)):
        store = PA.DayStore(spark, str(tmp_path / name))
        store.load(make(none), "a", key)
        assert merged(store.read()).count() == 0
        store.load(make(r), "b", key)
        n = merged(store.read()).count()
        assert n > 0 and merged(PA.DayStore(spark, str(tmp_path / name)).read()).count() == n
    store = PA.DayStore(spark, str(tmp_path / "s"))
    store.load(PA.slot_partials(r), "wrong", "datetime_15min")
    kept = PA.DayStore(spark, str(tmp_path / "kept"))
    store.compact(kept, PA.merge_slots, "datetime_15min", without=("wrong",))
    assert near(PA.load_from(kept.read()).collect()) == near(PA.load_from(PA.slot_partials(r)).collect())


@pytest.mark.parametrize("n", [1, 20, 200])
def test_small_clients_are_exact(spark, n):
    r = spark.createDataFrame([(1, dt.datetime(2024, 3, 1, 0, i % 60), "A", float(i * 7 % 31)) for i in range(n)], READING)
    assert PA.p95_from(PA.daily_sketches(r)).first()["p95_kw"] == PR.client_p95_exact(r, "2024-03-01", "2024-03-02").first()["p95_kw"]
