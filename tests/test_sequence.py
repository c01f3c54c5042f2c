import random

import pytest

from chunklake.operators import sequence as S


@pytest.mark.parametrize("keys", ["dense", "sparse", "one", "none"])
def test_running_sums(spark, keys):
    r = random.Random(1)
    ids = {"dense": range(500), "sparse": sorted({r.randint(-(2**62), 2**62) for _ in range(300)}), "one": [7], "none": []}[keys]
    rows = [(k, r.randint(0, 9)) for k in ids]
    df = spark.createDataFrame(rows, "k bigint, n int")
    want, total = {}, 0
    for k, n in rows:
        want[k], total = total, total + n
    for bucket in (4, S.BUCKET):
        if keys == "sparse" and bucket == 4:
            continue  # thirty rounds
        assert {x["k"]: x["before"] for x in S.running(df, "k", df["n"], "before", bucket).collect()} == want


def test_greedy_batches(spark):
    r = random.Random(2)
    rows = [(g, k, r.randint(0, 30)) for g in ("a", "b", None) for k in range(200)]
    want, state = {}, {}
    for g, k, n in rows:
        b, total = state.get(g, (0, 0))
        want[g, k] = b
        state[g] = (b + 1, 0) if total + n >= 50 else (b, total + n)
    got = S.greedy_batches(spark.createDataFrame(rows, "g string, k bigint, n int"), "g", "k", "n", 50).collect()
    assert {(x["g"], x["k"]): x["batch"] for x in got} == want
