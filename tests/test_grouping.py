"""Grouping by contraction against union-find, growth on near copies and hot
tokens, and G3 attach in every split."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_similarity import brute_pairs, union_find
from tidewire.operators import similarity as G
from tidewire.sources.io import keyed_update


def token_set(title):
    return {w for w in title.split() if len(w) >= 3}


def random_titles(seed, n, vocab=30, longest=8):
    rng = random.Random(seed)
    words = [f"w{i:03d}" for i in range(vocab)]
    out = [" ".join(rng.sample(words[:rng.randint(8, vocab)], rng.randint(0, longest))) for _ in range(n)]
    for i in range(0, n, 7):  # copies and near copies
        out[i] = out[rng.randrange(n)]
    return out


@pytest.mark.parametrize("seed, per_posting", [(1, 0), (2, 0), (1, 4)])
def test_components_equal_union_find(spark, monkeypatch, seed, per_posting):
    """With no pair left to the exact join at first, heads do all the work they can."""
    monkeypatch.setattr(G, "PAIRS_PER_POSTING", per_posting)
    titles = random_titles(seed, 150)
    df = spark.createDataFrame(list(enumerate(titles)), "id long, title string")
    got = {r.id: r.story_group_id for r in G.story_components(df).collect()}
    sets = {i: token_set(t) for i, t in enumerate(titles)}
    assert got == union_find(sorted(sets), brute_pairs(sets))


def near_copies(n):
    """All share six of eight words; the other two are of their own."""
    return [f"alpha beta gamma delta epsilon zeta a{i:06d} b{i:06d}" for i in range(n)]


def hot_token(n):
    """One word in all titles; nothing is similar."""
    return [f"breaking u{i:06d}" for i in range(n)]


def comparisons(spark, monkeypatch, titles):
    """Pairs that meet on a posting, of all turns; those fetched for the exact test."""
    met, verified = [], []
    plain_counted, plain_verified = G._counted, G._verified

    def counted(df, *args):
        met.append(df.count())
        return plain_counted(df, *args)

    def exact(pairs, *args):
        verified.append(pairs.count())
        return plain_verified(pairs, *args)

    monkeypatch.setattr(G, "_counted", counted)
    monkeypatch.setattr(G, "_verified", exact)
    df = spark.createDataFrame(list(enumerate(titles)), "id long, title string")
    groups = G.story_components(df).select("story_group_id").distinct().count()
    return sum(met), sum(verified), groups


@pytest.mark.parametrize("make, groups", [(near_copies, lambda n: 1), (hot_token, lambda n: n)])
def test_comparisons_grow_with_the_input(spark, make, groups):
    counts = []
    for n in (500, 2000):
        with pytest.MonkeyPatch.context() as patch:
            met, verified, found = comparisons(spark, patch, make(n))
        assert found == groups(n)
        counts.append((met, verified))
    (met, verified), (more_met, more_verified) = counts
    assert more_met <= 5 * met + 100 and more_met <= 20 * 2000
    assert more_verified <= 5 * verified + 100 and more_verified <= 4 * 2000


def test_forty_thousand_near_copies(spark):
    df = spark.range(40_000).select("id", F.concat(
        F.lit("alpha beta gamma delta epsilon zeta a"), F.col("id"), F.lit(" b"), F.col("id")).alias("title"))
    assert G.story_components(df).agg(F.countDistinct("story_group_id"), F.max("story_group_id")).first()[:] == (1, 0)


SCHEMA = "id long, title string, summary string, source string, fetched_at timestamp, story_group_id long, is_duplicate int"


@pytest.mark.parametrize("per_posting", [0, 4])
def test_long_titles(spark, monkeypatch, per_posting):
    """Sets of some hundred tokens around the threshold."""
    monkeypatch.setattr(G, "PAIRS_PER_POSTING", per_posting)
    rng = random.Random(8)
    words = [f"w{i:04d}" for i in range(400)]
    base = [rng.sample(words, 150) for _ in range(6)]
    titles = []
    for i in range(90):
        kept = rng.sample(base[i % 6], rng.randint(60, 150))
        titles.append(" ".join(kept + rng.sample(words, rng.randint(0, 60))))
    df = spark.createDataFrame(list(enumerate(titles)), "id long, title string")
    sets = {i: token_set(t) for i, t in enumerate(titles)}
    pairs = brute_pairs(sets)
    assert pairs and {r.id: r.story_group_id for r in G.story_components(df).collect()} == union_find(sorted(sets), pairs)
    reps, _ = G.collapse_copies(G.token_sets(df))
    assert {(r.id_a, r.id_b) for r in G.similar_pairs(reps).collect()} == pairs


def store_of(spark, titles):
    rows = [(i, t, "s" * (i % 5), f"src{i % 3}", None, None) for i, t in enumerate(titles)]
    df = spark.createDataFrame(rows, "id long, title string, summary string, source string, g long, d int")
    return df.select("id", "title", "summary", "source", F.to_timestamp(F.lit("2024-01-30 20:00:00")).alias("fetched_at"),
                     F.col("g").alias("story_group_id"), F.col("d").alias("is_duplicate"))


def as_of():
    return F.to_timestamp(F.lit("2024-01-31 00:00:00"))


@pytest.mark.parametrize("order", [(2, 0, 1), (1, 1, 1)])
def test_attach_in_any_split_equals_grouping_at_once(spark, order):
    titles = random_titles(5, 90)
    store = store_of(spark, titles)
    want = {r.id: (r.story_group_id, r.is_duplicate) for r in G.story_groups(store, as_of()).collect()}
    arrived = None
    for part in dict.fromkeys(order):
        batch = store.where(F.col("id") % 3 == part) if len(set(order)) > 1 else store
        arrived = batch if arrived is None else arrived.unionByName(batch)
        updates = G.story_groups(arrived, as_of(), mode="attach")
        rows = keyed_update(arrived, updates, "id", ["story_group_id", "is_duplicate"]).collect()
        arrived = spark.createDataFrame([tuple(r[c] for c in store.columns) for r in rows], SCHEMA)
    assert {r.id: (r.story_group_id, r.is_duplicate) for r in arrived.collect()} == want


def test_attach_merges_groups_also_outside_the_window(spark):
    old = "2024-01-20 00:00:00"
    rows = [(1, "storm hits coast", "aaaa", old, 1, 0), (2, "storm hits coast today", "a", "2024-01-30 20:00:00", 1, 1),
            (3, "flood follows rain", "aa", "2024-01-30 20:00:00", 3, 0), (4, "quiet day elsewhere", "a", "2024-01-30 20:00:00", 4, 0),
            (5, "storm hits coast flood follows rain", "a", "2024-01-30 21:00:00", None, None)]
    store = spark.createDataFrame(rows, "id long, title string, summary string, f string, story_group_id long, is_duplicate int") \
        .withColumn("fetched_at", F.to_timestamp("f")).withColumn("source", F.lit("s")).drop("f")
    got = {r.id: (r.story_group_id, r.is_duplicate, r.group_size) for r in G.attach_groups(store, as_of()).collect()}
    assert got == {1: (1, 0, 4), 2: (1, 1, 4), 3: (1, 1, 4), 5: (1, 1, 4)}  # 4 is untouched


def unlike(seed, n, vocab=120, each=12):
    """Random sets over one small vocabulary: they share words, few are similar."""
    rng = random.Random(seed)
    words = [f"w{i:03d}" for i in range(vocab)]
    return [" ".join(rng.sample(words, each)) for _ in range(n)]


def test_unlike_sets_end_where_they_meet(spark, monkeypatch):
    """Postings of a common vocabulary bring most sets together; the pairs that
    are shuffled and whose token sets are fetched are few."""
    titles = unlike(4, 400)
    sets = {i: token_set(t) for i, t in enumerate(titles)}
    met, verified, groups = comparisons(spark, monkeypatch, titles)
    assert groups == len(set(union_find(sorted(sets), brute_pairs(sets)).values()))
    assert met <= 10 * len(titles) and verified <= 5 * len(titles)


@pytest.mark.parametrize("direct", [0, 20, 4096])
def test_meeting_by_class_or_directly_is_the_same(spark, monkeypatch, direct):
    monkeypatch.setattr(G, "DIRECT", direct)
    titles = random_titles(6, 120) + unlike(6, 60, 25)
    df = spark.createDataFrame(list(enumerate(titles)), "id long, title string")
    sets = {i: token_set(t) for i, t in enumerate(titles)}
    reps, cmap = G.collapse_copies(G.token_sets(df))
    rep = {r.id: r.rep for r in cmap.collect()}
    want = {(a, b) for a, b in brute_pairs(sets) if rep[a] == a and rep[b] == b}
    assert want and {(r.id_a, r.id_b) for r in G.similar_pairs(reps).collect()} == want
    assert {r.id: r.story_group_id for r in G.story_components(df).collect()} == union_find(sorted(sets), brute_pairs(sets))
