from qalytics.plans import Relations
from tests.conftest import SF001


def test_dq_checks_find_the_dirt(spark):
    got = dict(Relations(spark, SF001).data_quality.collect())
    # FIXTURES.md §3 at sf0.01
    assert got == {"Duplicate Runs": 300, "Future Creation Dates": 22, "Negative Counts": 30, "Start > End": 5}
