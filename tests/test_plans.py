"""Plans of whole analyses: how often the raw tables are read, and what stands in them."""

import pytest

import __spark_entry__ as entry
from cohortloom.operators import labs, scale
from cohortloom.plans import toxicity

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def plans(monkeypatch):
    """Plans of everything written on the way."""
    seen, write = [], scale.checkpointed

    def watched(df, *parts):
        seen.append(plan_of(df))
        return write(df, *parts)

    for module in (toxicity, labs, scale):
        monkeypatch.setattr(module, "checkpointed", watched)
    return seen


def scans(plans, table):
    return sum(line.count(f"/{table}.parquet") for p in plans for line in p.split("\n") if "FileScan" in line)


@pytest.mark.parametrize("name", ["h11_scaffold_completion", "g11_impute_own_record", "g8_blank_limits", "h8_lab_flags"])
def test_raw_labs_are_read_once(spark, plans, name):
    queries = entry.queries()
    name = next(n for n in queries if n.startswith(name.split("_")[0] + "_"))
    plans.append(plan_of(queries[name](spark, FOLDER)))
    assert scans(plans, "lineitem") == 1


def test_expectations_share_cohort_and_labs(spark, plans):
    plans.append(plan_of(entry.queries()["j9_expectations"](spark, FOLDER)))
    assert scans(plans, "lineitem") == 1
    # the cohort's customers are read for one written copy, not by each branch
    assert scans(plans, "customer") == 1


def test_labs_of_other_people_stop_before_the_milestones(spark, plans):
    from cohortloom.catalog.registry import sources
    from cohortloom.sources.views import Views

    toxicity.framed_labs(sources(Views(spark, FOLDER)))
    (written,) = [p for p in plans if scans([p], "lineitem")]
    depth = {word: min(line.index(word) for line in written.split("\n") if word in line) for word in ("LeftSemi", "Inner")}
    assert depth["LeftSemi"] > depth["Inner"]
    # codes and limits are made before the join, so that no key of a lab row but the order's is shuffled
    joined = [line for line in written.split("\n") if "Join [l_orderkey" in line]
    assert len(joined) == 1
    above = written[: written.index(joined[0])]
    assert "l_partkey" not in above and "l_suppkey" not in above


def test_only_rows_without_a_limit_meet_the_imputation_join(frame):
    schema = "studyid long, time_frame int, co_tox_lab_name int, co_tox_lab_normal_low double, co_tox_lab_normal_high double, co_tox_lab_result double"
    rows = [
        (1, 1, 17, None, None, 1.0),
        (1, 1, 17, 11.0, None, 2.0),
        (1, 1, 17, 12.0, None, 3.0),
        (1, 1, 6, None, None, 4.0),
        (1, 1, 6, None, 40.0, 5.0),
        (1, 1, 11, None, None, 6.0),
        (1, 2, 17, None, None, 7.0),
        (1, 1, None, None, None, 8.0),
        (None, 1, 17, None, None, 9.0),
        (None, 1, 17, 10.5, None, 10.0),
    ]
    filled = labs.impute_own_record(frame(rows, schema))
    got = {r["co_tox_lab_result"]: (r["co_tox_lab_normal_low"], r["co_tox_lab_normal_high"]) for r in filled.collect()}
    assert got == {
        1.0: (12.0, None), 2.0: (11.0, None), 3.0: (12.0, None), 4.0: (None, 40.0), 5.0: (None, 40.0),
        6.0: (None, None), 7.0: (None, None), 8.0: (None, None), 9.0: (None, None), 10.0: (10.5, None),
    }
    # rows are told apart before the join, and those with a limit go round it
    plan = plan_of(filled)
    assert "Union" in plan and "isnull(co_tox_lab_normal_low" in plan.split("LeftOuter")[1].lower()


def test_later_branches_read_their_lab_codes_only(spark):
    from cohortloom.catalog.registry import sources
    from cohortloom.sources.views import Views

    plan = plan_of(toxicity.framed_labs(sources(Views(spark, FOLDER))))
    asked = [line for line in plan.split("\n") if "FileScan" in line and "PartitionFilters" in line]
    assert len(asked) == 3
    assert sum("co_tox_lab_name" in line.split("PartitionFilters")[1].split("PushedFilters")[0] for line in asked) >= 2


def test_first_rows_without_a_sort_aggregate(spark):
    for name in ("f3_first_row_per_day", "c6_same_day_lookup"):
        plan = plan_of(entry.queries()[name](spark, FOLDER))
        assert "SortAggregate" not in plan and "WindowGroupLimit" in plan
