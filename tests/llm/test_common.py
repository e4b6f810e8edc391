import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from graphloom.llm.common import components, own_table, row_rank, running_sum, written


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=20))
def test_components(spark, links):
    got = {r.node: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {x: x for e in links for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in links)}


def test_a_long_chain(spark):
    ids = random.Random(5).sample(range(10**6), 200)
    got = components(spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "a long, b long")).collect()
    assert len(got) == 200 and {r.comp for r in got} == {min(ids)}


def test_ranks_and_sums(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i // 2, rng.randint(1, 9)) for i in range(300)]
    table = written(spark.createDataFrame(rows, "k string, i long, v long"), "t")
    for buckets in (1, 16):
        got = row_rank(table, ["k"], ["i", "v"], "r", buckets).collect()
        for k in ("a", "b", None):
            assert sorted(r.r for r in got if r.k == k) == list(range(sum(x[0] == k for x in rows)))
        known = table.where("k IS NOT NULL")
        sums = sorted(((r.s, r.v) for r in running_sum(known, ["k"], ["i", "v"], "v", "s", buckets).where("k = 'b'").collect()))
        at = 0
        for s, v in sums:
            assert s <= at or s == at
            at = max(at, s + v)
        assert at == sum(x[2] for x in rows if x[0] == "b")


def test_one_table_a_worker():
    one = own_table("x", dict)
    one["k"] = 1
    assert own_table("x", dict) is one and own_table("y", list) == [] and own_table("x", dict) == {}
