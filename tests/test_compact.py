"""Properties of compaction: applying net changes equals applying rows one by one."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.operators import apply, compact

IMAGE = "struct<k:bigint,v:string>"
SCHEMA = f"lsn long, op string, before {IMAGE}, after {IMAGE}"


def history(seed):
    """A valid log over a few keys (updates may move a key), with the state before and after it."""
    state = {k: f"base{k}" for k in range(0, 4)}
    base, log = dict(state), []
    for lsn, (what, k, to, value) in enumerate(seed):
        if what == "I" and k not in state:
            state[k] = value
            log.append((lsn, "I", None, (k, value)))
        elif what == "D" and k in state:
            log.append((lsn, "D", (k, state.pop(k)), None))
        elif what == "U" and k in state and (to == k or to not in state):
            log.append((lsn, "U", (k, state.pop(k)), (to, value)))
            state[to] = value
    return base, log, state


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("IUD"), st.integers(0, 5), st.integers(0, 5), st.sampled_from(["a", "b", "base1", None])), max_size=25))
def test_net_changes_equal_row_by_row(spark, seed):
    base, log, want = history(seed)
    target = spark.createDataFrame(list(base.items()), "k long, v string")
    changes = spark.createDataFrame(log, SCHEMA)
    net = apply.merge(target, compact.compact(changes, ["k"]), ["k"])
    assert {r["k"]: r["v"] for r in net.collect()} == want
    by_row = apply.apply_rows(target, changes, ["k"])
    assert {r["k"]: r["v"] for r in by_row.collect()} == want


def test_equal_delete_and_insert_annihilate(spark):
    log = spark.createDataFrame([(1, "D", (1, "x"), None), (2, "I", None, (1, "x"))], SCHEMA)
    assert compact.compact(log, ["k"]).collect() == []


def test_update_of_an_absent_row_inserts_it(spark):
    log = spark.createDataFrame([(1, "U", (9, "x"), (9, "y"))], SCHEMA)
    out = apply.merge(spark.createDataFrame([], "k long, v string"), compact.compact(log, ["k"]), ["k"])
    assert [tuple(r) for r in out.collect()] == [(9, "y")]


def test_bag_delete_removes_copies_and_matches_nulls(spark):
    rows = spark.createDataFrame([("a", None)] * 3 + [("b", 1)], "x string, y long")
    gone = spark.createDataFrame([("a", None)] * 2 + [("c", 1)], "x string, y long")
    assert sorted(tuple(r) for r in apply.bag_delete(rows, gone).collect()) == [("a", None), ("b", 1)]
