import pytest

from linkblocks import plans
from linkblocks.plans import inputs as I

from .oracle import compare

Q, S = plans.queries(), plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(S))
def test_query_equals_sql(spark, name):
    assert ": ok " in compare(spark, name, Q[name], S[name], "/root/testdata/sf0.001")


def test_attribute_clustering_takes_all_entities(spark):
    sf = "/root/testdata/sf0.001"
    for side in (0, 1):
        heads = lambda f: {r.head for r in f(spark, sf, side).df.select("head").collect()}  # noqa: B023, E731
        assert heads(I.graph_places) == heads(I.graph_attributes)
    rows = Q["attribute_clustering"](spark, sf).collect()
    n = [sum(I.read(spark, sf, t).count() for t in (own, "nation", "region")) for own in ("customer", "supplier")]
    # every entity has a label, and at least one block where the other side has it too
    assert rows and sum(r.n_left for r in rows) >= n[0] and sum(r.n_right for r in rows) >= n[1]
