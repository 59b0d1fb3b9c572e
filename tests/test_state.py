"""Both machines against plain sequential folds, over all short sequences."""

import itertools

import pytest

from flagframe.operators.state import job_history, job_rejections, job_state, job_state_restartable

OPS = ["start", "cancel", "retry", "complete", "fail", "timeout"]
BIT = {"complete": 16, "fail": 32, "timeout": 64}


def guarded(ops):
    mask, refused = 0, []
    for i, op in enumerate(ops):
        ended = mask & 112
        if op == "cancel":
            mask |= 4
        elif ended or (op == "start" and mask & 2):
            refused.append(i)
        elif op == "start":
            mask |= 2
        elif op == "retry":
            mask = (mask | 8) & ~2
        elif op == "complete":
            mask = (mask | 16) & ~(2 | 8 | 4)
        else:
            mask = (mask | BIT[op]) & ~(2 | 8)
    return mask, refused


def restartable(ops):
    mask = 0
    for op in ops:
        if op == "start":
            mask = (mask & ~(8 | 16 | 32)) | 2
        elif op == "retry":
            mask |= 4 if mask & 2 else 0
        elif op != "cancel":
            mask = {"complete": 8, "fail": 16, "timeout": 32}[op]
    return mask


SEQUENCES = [s for n in range(1, 5) for s in itertools.product(OPS, repeat=n)]
SEQUENCES.append(tuple(OPS[i * 7 % 3] for i in range(40)))  # one long job that never ends
SEQUENCES.append(("start", "retry") * 15 + ("fail",) + ("cancel", "start") * 5)


@pytest.fixture(scope="module")
def log(spark):
    rows = [(k, i, op) for k, ops in enumerate(SEQUENCES) for i, op in enumerate(ops)]
    return spark.createDataFrame(rows, "k int, i int, op string").repartition(6).cache()


def test_guarded_machine(log):
    got = {r.k: r["mask"] for r in job_state(log, ["k"], ["i"]).collect()}
    assert got == {k: guarded(ops)[0] for k, ops in enumerate(SEQUENCES)}


def test_rejections(log):
    got = {(r.k, r.i) for r in job_rejections(log, ["k"], ["i"]).collect()}
    assert got == {(k, i) for k, ops in enumerate(SEQUENCES) for i in guarded(ops)[1]}


def test_restartable_machine(log):
    got = {r.k: r["mask"] for r in job_state_restartable(log, ["k"], ["i"]).collect()}
    # A job with nothing but cancels has no event this machine knows.
    expected = {k: restartable(ops) for k, ops in enumerate(SEQUENCES) if set(ops) != {"cancel"}}
    assert got == expected


def test_listed_cases():
    assert guarded(["start", "start"]) == (2, [1])
    assert guarded(["start", "retry", "start"])[0] == 10
    assert guarded(["start", "cancel", "fail"])[0] == 36
    assert guarded(["start", "complete", "cancel"])[0] == 20
    assert guarded(["start", "complete", "start", "fail"]) == (16, [2, 3])
    assert restartable(["start", "complete", "start", "fail"]) == 16
    assert restartable(["start", "timeout"]) == 32


def test_mask_counts_of_the_event_table(spark, sf_dir):
    from flagframe.plans.queries import queries

    counts = queries()["job_state"](spark, sf_dir).groupBy("mask").count().collect()
    assert {r["mask"]: r["count"] for r in counts} == {
        2: 290, 4: 282, 6: 170, 8: 311, 10: 67, 12: 202, 14: 54, 16: 1027, 20: 267, 32: 866, 36: 470,
    }


def test_two_order_columns(spark):
    rows = [(1, 0, 1, "start"), (1, 0, 0, "retry"), (1, 1, 0, "cancel")]
    df = spark.createDataFrame(rows, "k int, t int, i int, op string")
    assert job_state(df, ["k"], ["t", "i"]).first()["mask"] == 14


@pytest.mark.parametrize("cut", [0, 1, 2, 3])
def test_rejections_continue_from_a_history(log, cut):
    """Events up to ``cut`` give a history; the rest is judged by it."""
    old, new = log.where(f"i < {cut}"), log.where(f"i >= {cut}")
    history = job_history(old, ["k"], ["i"])
    got = {(r.k, r.i) for r in job_rejections(new, ["k"], ["i"], previous=history).collect()}
    assert got == {(k, i) for k, ops in enumerate(SEQUENCES) for i in guarded(ops)[1] if i >= cut}
    merged = {r.k: (r.ended, r.moved) for r in job_history(new, ["k"], ["i"], previous=history).collect()}
    assert merged == {r.k: (r.ended, r.moved) for r in job_history(log, ["k"], ["i"]).collect()}
