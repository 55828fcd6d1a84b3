"""Hot keys: a third of all rows share one title / one URL."""

from pyspark.sql import functions as F

from tidewire.operators import ingest as I
from tidewire.operators import similarity as G


def test_hot_copy_group_is_collapsed_before_the_pair_join(spark):
    n = 3000
    rows = [(i, "breaking storm hits the coast" if i % 3 == 0 else f"story number{i} item{i * 7}")
            for i in range(n)]
    df = spark.createDataFrame(rows, "id long, title string")
    reps, cmap = G.collapse_copies(G.token_sets(df))
    # the 1000 copies become one representative: the pair join sees 2001 sets, not 3000
    assert reps.count() == 2001
    assert G.similar_pairs(reps).count() == 0
    comps = G.story_components(df)
    hot = comps.where(F.col("id") % 3 == 0).select("story_group_id").distinct().collect()
    assert [r.story_group_id for r in hot] == [0]
    assert comps.where(F.col("id") % 3 != 0).where(F.col("story_group_id") != F.col("id")).count() == 0


def test_hot_url_first_seen(spark):
    rows = [(i, "https://hot.example.com/x" if i % 3 == 0 else f"https://e.example.com/{i}", i % 7, i)
            for i in range(3000)]
    df = (spark.createDataFrame(rows, "id long, url string, source_ord int, item_ord long")
          .withColumn("url_hash", F.sha2("url", 256)))
    out = I.first_seen(df)
    hot = out.where(F.col("url") == "https://hot.example.com/x").collect()
    # first in (source_ord, item_ord) order among the hot rows: source 0, smallest item
    assert [r.id for r in hot] == [0]
    assert out.count() == 2001
