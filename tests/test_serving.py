from pyspark.sql import functions as F

from qalytics.operators import serving
from tests.conftest import rows

MART_COLS = "total_tests long, total_passed long, total_returned_cases long, total_blocked long, total_untested long, total_in_process long"


def test_status_breakdown_residual_and_pct(spark):
    m = spark.createDataFrame([(10, 5, 1, 1, 1, 0), (3, 1, 0, 0, 0, 0)], MART_COLS)
    got = {r["label"]: (r["value"], r["pct"]) for r in serving.status_breakdown(m).collect()}
    assert got["Fallidos"] == (4, 30.8) and got["Exitosos"] == (6, 46.2)
    empty = spark.createDataFrame([], MART_COLS)
    assert all(r["pct"] == 0.0 and r["value"] == 0 for r in serving.status_breakdown(empty).collect())
    over = spark.createDataFrame([(1, 5, 0, 0, 0, 0)], MART_COLS)
    assert {r["label"]: r["value"] for r in serving.status_breakdown(over).collect()}["Fallidos"] == 0


def test_kpi_header_empty_input_gives_no_row(spark):
    m = spark.createDataFrame([], "total_runs long, total_passed long, Soluciones_Certificadas_UAT long, "
                                  "Soluciones_Devueltas_UAT long, Soluciones_En_Proceso_UAT long, is_certified int, is_in_process int")
    issues = spark.createDataFrame([("Cerrado",), (None,), ("Backlog",)], "status string")
    assert serving.kpi_header(m, issues).count() == 0
    m2 = spark.createDataFrame([(2, 1, 0, 1, 0, 1, 0)], m.schema)
    r = serving.kpi_header(m2, issues).collect()[0]
    assert (r["total_defects"], r["active_defects"], r["certified_plans"]) == (3, 2, 1)


def test_defects_by_status_null_is_open_and_zero_filled(spark):
    issues = spark.createDataFrame([("Backlog", "Alta"), (None, None), ("Raro", "Media"), ("Mitigado", "Alta")],
                                   "status string, priority string")
    got = {r["name"]: r["value"] for r in serving.defects_by_status(issues).collect()}
    assert got == {"Abierto": 3, "En Progreso": 0, "Listo": 0, "Cerrado": 1}
    sev = {r["name"]: r["value"] for r in serving.defects_by_severity(issues).collect()}
    assert sev == {"Critico": 0, "Alto": 2, "Medio": 1, "Bajo": 0}


def test_pivot_totals_equal_unpivoted_totals(spark):
    from tests.conftest import SF001
    from qalytics.plans import Relations

    rel = Relations(spark, SF001)
    w = rel.workload_by_analyst
    p = rel.workload_pivot
    proj_cols = [c for c in p.columns if c not in ("analyst_name", "total")]
    cells = p.select(sum(F.coalesce(F.col(f"`{c}`"), F.lit(0)) for c in proj_cols).alias("s"), "total")
    assert cells.where("s != total").count() == 0
    assert p.agg(F.sum("total")).collect()[0][0] == w.agg(F.sum("total_assigned")).collect()[0][0]


def test_relation_head_unknown_type_reads_mart(spark):
    from tests.conftest import SF0001
    from qalytics.plans import Relations

    rel = Relations(spark, SF0001)
    assert serving.relation_head(rel, "nope").columns == rel.dashboard_mart.columns
    assert serving.relation_head(rel, "workload").columns == rel.workload_by_analyst.columns
    assert serving.relation_head(rel, "mart", limit=3).count() == 3


def test_demand_detail_draws_ranges_without_the_name_lists(spark):
    demand = spark.createDataFrame(
        [(p, "p", m, 2024, a, 1, n) for p, m, a, n in ((1, "2024-02", 1, "b"), (1, "2024-02", 1, None), (1, "2024-02", 1, "a"),
                                                       (2, "2024-01", 1, "z"), (1, "2024-01", 3, "y"), (None, None, None, "x"))],
        "project_id long, project_name string, month_key string, year long, analyst_count long, test_count long, analyst_names string")
    got = serving.demand_detail(demand)
    assert [r["analyst_names"] for r in got.collect()] == ["x", "y", "z", None, "a", "b"]
    ranges = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "rangepartitioning(" in line]
    assert ranges and all("analyst_names" not in line for line in ranges)
