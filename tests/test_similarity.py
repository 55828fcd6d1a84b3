"""J3 against brute force, G1 against union-find, W2 anchors, plan shape."""

import random
from fractions import Fraction

from pyspark.sql import functions as F

from tidewire.operators import similarity as G


def brute_pairs(sets: dict[int, set[str]], t=Fraction(35, 100)):
    ids = sorted(sets)
    out = set()
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            sa, sb = sets[a], sets[b]
            if sa and sb and Fraction(len(sa & sb), len(sa | sb)) >= t:
                out.add((a, b))
    return out


def union_find(ids, edges):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    comp = {}
    for i in ids:
        comp[i] = find(i)
    # label = min member
    mins = {}
    for i, r in comp.items():
        mins[r] = min(mins.get(r, i), i)
    return {i: mins[r] for i, r in comp.items()}


def _titles(rng, n):
    vocab = [f"w{i:03d}" for i in range(40)]
    rows = []
    for i in range(n):
        k = rng.randint(0, 7)
        words = rng.sample(vocab[: rng.randint(8, 40)], k)
        if rng.random() < 0.2 and rows:
            words = rows[rng.randrange(len(rows))][1].split()  # exact copies
        rows.append((i, " ".join(words)))
    return rows


def test_similar_pairs_match_brute_force(spark):
    rng = random.Random(7)
    rows = _titles(rng, 160)
    df = spark.createDataFrame(rows, "id long, title string")
    sets = G.token_sets(df)
    reps, cmap = G.collapse_copies(sets)
    got = {(r.id_a, r.id_b) for r in G.similar_pairs(reps).collect()}
    token = {i: {w for w in t.split() if len(w) >= 3} for i, t in rows}
    # representatives: min id per distinct non-empty set
    rep_of = {}
    for i in sorted(token):
        if token[i]:
            rep_of.setdefault(frozenset(token[i]), i)
    rep_sets = {i: token[i] for i in rep_of.values()}
    assert got == brute_pairs(rep_sets)


def test_components_match_union_find(spark):
    rng = random.Random(3)
    rows = _titles(rng, 200)
    df = spark.createDataFrame(rows, "id long, title string")
    got = {r.id: r.story_group_id for r in G.story_components(df).collect()}
    token = {i: {w for w in t.split() if len(w) >= 3} for i, t in rows}
    want = union_find([i for i, _ in rows], brute_pairs(token))
    assert got == want


def test_chain_and_star_graphs(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(1000, 1000 + i) for i in range(1, 80)]
    edges = spark.createDataFrame(chain + star, "a long, b long")
    verts = spark.createDataFrame([(i,) for i in list(range(61)) + list(range(1000, 1080)) + [5000]], "id long")
    got = {r.id: r.component for r in G.connected_components(edges, verts).collect()}
    assert all(got[i] == 0 for i in range(61))
    assert all(got[i] == 1000 for i in range(1000, 1080))
    assert got[5000] == 5000


def test_exact_threshold_and_edge_tokens(spark):
    # 7 shared of 20 in the union: exactly 0.35 -> grouped
    a = " ".join(f"t{i:02d}x" for i in range(0, 13))
    b = " ".join(f"t{i:02d}x" for i in range(6, 20))
    rows = [(1, a), (2, b), (3, ""), (4, "ab cd ef"), (5, "ab cd ef"), (6, "Café olé")]
    df = spark.createDataFrame(rows, "id long, title string")
    got = {r.id: r.story_group_id for r in G.story_components(df).collect()}
    assert got[1] == got[2] == 1
    assert got[3] == 3 and got[4] == 4 and got[5] == 5  # empty sets never group
    toks = {r.id: r.tokens for r in G.token_sets(df).collect()}
    assert toks[6] == ["caf"]  # the accent splits the word; "ol" is too short


def test_anchor_ties_and_nulls(spark):
    rows = [(1, 10, "abc"), (2, 10, "xyz"), (3, 10, None), (4, 20, None)]
    df = spark.createDataFrame(rows, "id long, story_group_id long, summary string")
    got = {r.id: r.is_duplicate for r in G.choose_anchors(df).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 0}


def test_similarity_plan_has_no_cartesian(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha beta delta")], "id long, title string")
    reps, _ = G.collapse_copies(G.token_sets(df))
    plan = G.similar_pairs(reps)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_positional_filter_exact_on_skewed_vocab(spark):
    """Few very common words + rare ones, many short sets: the prefix,
    length and position filters together must keep every similar pair."""
    for seed in (11, 12, 13):
        rng = random.Random(seed)
        common = ["the", "and", "for"]
        rare = [f"r{i:03d}" for i in range(60)]
        rows = []
        for i in range(220):
            k = rng.randint(1, 9)
            words = set(rng.sample(common, rng.randint(0, 3)))
            words |= set(rng.sample(rare, k))
            rows.append((i, " ".join(sorted(words))))
        df = spark.createDataFrame(rows, "id long, title string")
        reps, _ = G.collapse_copies(G.token_sets(df))
        got = {(r.id_a, r.id_b) for r in G.similar_pairs(reps).collect()}
        token = {i: set(t.split()) for i, t in rows}
        rep_of = {}
        for i in sorted(token):
            rep_of.setdefault(frozenset(token[i]), i)
        assert got == brute_pairs({i: token[i] for i in rep_of.values()}), seed
