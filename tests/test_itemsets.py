import random

import duckdb
import pandas as pd
import pytest

from tabsmith.operators import rules
from tabsmith.operators.fptree import frequent_itemsets, mine


def brute(baskets, least):
    from collections import Counter
    from itertools import combinations

    n = Counter()
    for b, c in baskets:
        have = sorted({x for x in b if x is not None})
        for k in range(1, len(have) + 1):
            for s in combinations(have, k):
                n[s] += c
    return {(k, v) for k, v in n.items() if v >= least}


def sets(df):
    rows = [(tuple(r["items"]), r["n"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def counted(spark, baskets):
    return spark.createDataFrame(baskets, "items array<string>, c long")


@pytest.mark.parametrize("cells,groups", [(2_000_000, 3), (40, 2), (8, 4), (1, 1)])
def test_any_cut_of_the_work_gives_the_same_sets(spark, cells, groups):
    r = random.Random(9)
    # A third of all rows is one basket; some items repeat, some are NULL.
    base = [([x for x in "abcdefgh" if r.random() < 0.45] + ["a", None][: r.randrange(3)], r.randrange(1, 4)) for _ in range(60)]
    base.append((list("abcde"), 50))
    got = sets(frequent_itemsets(counted(spark, base), 0.15, groups=groups, cells=cells))
    assert got == brute(base, 0.15 * sum(c for _, c in base) - 1e-9)


def test_long_baskets_equal_sql(spark):
    """Forty columns: 2^40 subsets a basket; counts of all pairs and triples by DuckDB."""
    r = random.Random(3)
    rows = [tuple(r.randrange(2 + j % 4) for j in range(40)) for _ in range(1500)]
    names = [f"k{j}" for j in range(40)]
    df = spark.createDataFrame(rows, ", ".join(f"{x} int" for x in names)).selectExpr(*[f"'v' || {x} AS {x}" for x in names])
    items, _ = rules.binned_items(df, names)
    got = {s: n for s, n in sets(rules.frequent_itemsets(rules.count_baskets(items, names), 0.13))}
    flat = pd.DataFrame([(i, f"{k}:v{v}") for i, row in enumerate(rows) for k, v in zip(names, row)], columns=["id", "item"])
    con = duckdb.connect()
    con.register("flat", flat)
    want = {(a,): n for a, n in con.sql("SELECT item, count(*) FROM flat GROUP BY 1 HAVING count(*) >= 195").fetchall()}
    want |= {tuple(x): n for *x, n in con.sql("SELECT a.item, b.item, count(*) FROM flat a JOIN flat b ON a.id = b.id AND a.item < b.item GROUP BY 1, 2 HAVING count(*) >= 195").fetchall()}
    triples = "SELECT a.item, b.item, c.item, count(*) FROM flat a JOIN flat b ON a.id = b.id AND a.item < b.item JOIN flat c ON a.id = c.id AND b.item < c.item GROUP BY 1, 2, 3 HAVING count(*) >= 195"
    want |= {tuple(x): n for *x, n in con.sql(triples).fetchall()}
    assert {k: v for k, v in got.items() if len(k) <= 3} == want
    assert any(len(k) == 3 for k in want)


def test_empty_and_rare(spark):
    assert frequent_itemsets(counted(spark, []), 0.1).collect() == []
    assert frequent_itemsets(counted(spark, [([], 4), ([None], 2)]), 0.1).collect() == []
    rare = counted(spark, [([str(i)], 1) for i in range(30)])
    assert frequent_itemsets(rare, 0.5).collect() == []
    # A threshold below one row keeps every set that occurs.
    assert sets(frequent_itemsets(counted(spark, [(["x", "y"], 1)]), 0.0)) == {(("x",), 1), (("y",), 1), (("x", "y"), 1)}


def test_one_tree():
    found = dict(mine([([0, 1, 2], 2), ([0, 2], 1), ([1], 5)], 2))
    assert {tuple(sorted(k)): v for k, v in found.items()} == {(0,): 3, (1,): 7, (2,): 3, (0, 1): 2, (0, 2): 3, (1, 2): 2, (0, 1, 2): 2}
