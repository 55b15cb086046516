import numpy as np

from callmetrics.operators import learners


def test_perceptron_separates_and_keeps_what_is_right():
    x = np.array([[1.0, 2.0], [1.0, -2.0], [1.0, 3.0], [1.0, -1.0]])
    y = np.array([1.0, -1.0, 1.0, -1.0])
    first, last = learners.policy(np.zeros(2), x, y)
    assert (np.sign(x @ last) == y).all() and (y * (x @ last)).min() >= (y * (x @ first)).min()
    sure = np.array([0.0, 5.0])
    assert (learners.trained(sure, x, y, np.ones(4)) == sure).all()


def test_one_step_by_hand():
    got = learners.trained(np.array([0.0]), np.array([[2.0]]), np.array([1.0]), np.array([1.0]), epochs=1, rate=0.1, margin=1.0)
    assert got.tolist() == [0.2]


def test_mined_rows():
    x, y = np.array([[3.0], [0.5], [-1.0]]), np.ones(3)
    at, much = learners.mined(np.array([1.0]), x, y, np.ones(3))
    assert at.tolist() == [2, 1] and much.tolist() == [1.75, 1.75]
    at, much = learners.mined(np.array([9.0]), x[:2], y[:2], np.ones(2))
    assert at.tolist() == [1, 0] and much.tolist() == [1.4, 1.4]


def test_policies_of_tools(spark):
    """A bounded number of rows, both labels needed, the same whatever the order."""
    rows = [(t, f"{i:032x}", float(1 if i % 2 else -1) if t != "one" else 1.0, [1.0, float(i % 2)]) for t in ("a", "one") for i in range(40)]
    df = lambda r: spark.createDataFrame(r, "tool_id string, k string, label double, x array<double>")
    weights = {"bias": 0.0, "odd": 0.0}
    got = [sorted(map(tuple, learners.tool_policies(df(r), weights, most=30).collect())) for r in (rows, rows[::-1])]
    assert got[0] == got[1] and {r[0] for r in got[0]} == {"a"}
    assert learners.global_policy(df([]), weights).count() == 2
    assert learners.global_policy(df(rows), weights, most=10).count() == 2
