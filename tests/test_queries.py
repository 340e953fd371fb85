import duckdb
import pyarrow as pa
import pytest

from strandline.operators import captions, joins
from strandline.plans import registry
from tests.oracle import SMALL, assert_same, connection

QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, con, name):
    assert_same(QUERIES[name](spark, SMALL), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_scores_need_no_python(spark):
    plan = registry.repeat_scores(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_best_match_of_odd_names(spark):
    """Names inside others, equal, empty, null, of other letters; missing hints, models and contents; against the nested loop."""
    names = ["scene_1", "scene_12", "x_scene_1_y", "ene", "n", "", "eeee", "ee", "übung", "bung 😀", "😀", None, "none of them"]
    asked = [(s, h) for s in names[:12] for h in ("user", "", None, "none")] + [("far away", "user")]
    results = [(s, m, None if (i * 7 + j) % 5 == 0 else f"{s}/{m}", (i * 3 + j) * 7 % 41) for i, s in enumerate(names) if s != "" for j, m in enumerate(("user", "assistant", None))]
    con = duckdb.connect()
    for some in (results, results[:3], [(None, "user", "only", 1)], [("", "user", "all", 50), *results]):
        r = spark.createDataFrame(some, "scene string, model string, content string, i int")
        w = spark.createDataFrame(asked + asked[:3], "scene string, hint string")
        con.register("r", pa.table(dict(zip(r.columns, map(list, zip(*some))))))
        con.register("w", pa.table(dict(zip(w.columns, map(list, zip(*asked))))))
        sql = """WITH p AS (SELECT w.scene, w.hint, i, content, CASE WHEN i IS NULL THEN 0 WHEN coalesce(hint, '') = '' OR contains(model, hint) THEN 2 ELSE 1 END AS fit FROM w LEFT JOIN r ON contains(r.scene, w.scene) OR contains(w.scene, r.scene))
        SELECT scene, hint, coalesce(content, (SELECT arg_min_null(content, i) FROM r)) AS content FROM (SELECT *, row_number() OVER (PARTITION BY scene, hint ORDER BY fit DESC, i) AS k FROM p) WHERE k = 1"""
        assert_same(captions.best_match(w, r, "i"), con, sql)


def test_best_match_compares_no_pairs(spark):
    plan = QUERIES["best_result_match"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Join" in x and "Contains" in x] and "Window" not in plan


def test_waves_of_longer_and_odd_user_ids(spark, tmp_path):
    """Names of users 339 and 763 begin with those of users 3 and 7, which are moved; other users are below 0 or unknown."""
    users = [3, 7, 339, 763, 3003, 84 * 10**15 + 3, 1, 4, 5, -1, -6, -81, None]
    rows = [(e, u, "view", 0.5 + e) for e, u in enumerate(users * 2)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").selectExpr("*", "timestamp_ntz'2024-01-01 00:00:00' AS ts").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    assert_same(QUERIES["cost_by_wave"](spark, str(tmp_path)), con, ORACLES["cost_by_wave"])


def test_names_cut_on_either_side(spark):
    whole = "4-15_hkt1323-1709_226m_544095a4-a5a0-5eda-b82e-99d1cdcaa61b"
    names = {whole: True, whole[:28]: True, whole[:28] + "x": True, whole[:27] + "x": False, "5-1_a": True, "5-1_ab": False, "5-1_": False, "5-1_b": True}
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    got = rows.select("n", joins.in_either_prefix(rows.n, [whole, "5-1_a", "5-1_b"], 28)).collect()
    assert dict(map(tuple, got)) == names
    assert [r[1] for r in rows.select("n", joins.in_either_prefix(rows.n, [whole[:28]], 28)).collect()] == [n.startswith(whole[:28]) for n in names]
