"""S5 against a sequential model: rows inserted one by one under two unique keys."""

import random

import pytest

from tidewire.operators import ingest as I

SCHEMA = "id long, url string, url_hash string, source_ord int, item_ord long, title string"


def sequential(batch, stored):
    urls, hashes = {u for u, _ in stored if u}, {h for _, h in stored if h}
    out = []
    for row in sorted(batch, key=lambda r: (r[3], r[4])):
        _, u, h, *_ = row
        if (u is not None and u in urls) or (h is not None and h in hashes):
            continue
        urls.add(u)
        hashes.add(h)
        out.append(row[0])
    return sorted(out)


def insert(spark, batch, stored):
    got = I.insert_if_absent(spark.createDataFrame(batch, SCHEMA).repartition(4),
                             spark.createDataFrame(stored, "url string, url_hash string"))
    return sorted(r.id for r in got.collect())


def test_refused_rows_take_no_key(spark):
    batch = [(1, "u1", "h1", 0, 1, "a"), (2, "u2", "h1", 0, 2, "b"), (3, "u2", "h3", 0, 3, "c"),
             (4, "u3", "h3", 0, 4, "d"), (5, "u3", "h5", 0, 5, "e")]
    assert insert(spark, batch, [("x", "y")]) == [1, 3, 5] == sequential(batch, [])


@pytest.mark.parametrize("seed", range(4))
def test_equals_sequential_model(spark, seed):
    rng = random.Random(seed)
    n = 120

    def key(mark, most):
        return None if rng.random() < .1 else f"{mark}{rng.randrange(most)}"

    batch = [(i, key("u", 45), key("h", 45), rng.randrange(3), i, "t") for i in rng.sample(range(1000), n)]
    stored = [(key("u", 45), key("h", 45)) for _ in range(8)]
    assert insert(spark, batch, stored) == sequential(batch, stored)


def test_long_chain_and_hot_key(spark):
    # each row is first for one key only until the row before it is decided
    chain = [(i, f"u{(i + 1) // 2}", f"h{i // 2}", 0, i, "c") for i in range(12)]
    hot = [(100 + i, "hot", f"k{i}", 1, i, "h") for i in range(300)]
    assert insert(spark, chain + hot, [("x", "y")]) == sequential(chain + hot, [])


def test_ties_identical_rows_and_empty(spark):
    same = (1, "u", "h", 0, 1, "t")
    assert insert(spark, [same, same], [("x", "y")]) == [1]
    tied = insert(spark, [(1, "u", "h1", 0, 1, "a"), (2, "u", "h2", 0, 1, "b")], [("x", "y")])
    assert len(tied) == 1  # of equal order: told apart by content
    null = (3, None, None, 0, 1, "n")
    assert insert(spark, [null, null, (4, None, "h", 0, 2, "x"), (5, None, "h", 0, 3, "y")], [("x", "y")]) == [3, 3, 4]
    assert insert(spark, [], [("x", "y")]) == []
    assert insert(spark, [(6, "x", "new", 0, 1, "s"), (7, "new", "y", 0, 2, "s")], [("x", "y")]) == []
