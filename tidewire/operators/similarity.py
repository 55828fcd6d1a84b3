"""Story grouping: P3 tokens, J3 exact Jaccard self-join, G1 connected
components, W2 anchors, A3 group stats, G2/G3 composition.

Scale design
------------
* Exact copies (identical non-empty token sets) are collapsed first: one
  representative per distinct set (min id).  A group of copies holding a third
  of all rows therefore never reaches the pair join.
* Postings are a prefix-filtered inverted index (Bayardo et al. 2007): tokens
  ordered by global frequency (rare first), only the first
  ``n - ceil(t*n) + 1`` tokens of each set are indexed.  A posting's class is
  its token with the orders of magnitude of the set's size and of the number of
  its tokens from this one on; which classes of a token can hold similar sets
  follows from the length and position bounds alone, so those class pairs are
  joined first, and sets meet by an equi-join on them.  A very common token does
  not bring all of its sets together.
* Postings carry a bitmap of their set, which bounds what two sets can have in
  common (Sandes et al. 2017): pairs below their overlap end where they meet and
  are not shuffled.  Postings of a token of up to ``DIRECT`` of them meet by an
  equi-join on the token alone; more frequent tokens by their class pairs.
* Pairs that pass are counted over their shared postings; similar sets share at
  least a number of them that follows from their sizes, and only pairs with
  enough fetch their token sets for the exact test.
* J3 emits every similar pair.  G2 and G3 need components only
  (``link_labels``): sets are compared with the head of each of their postings
  and sizes, similar ones are contracted to one label, and only postings that
  still span several labels go on; what is left is joined exactly across
  labels.  n near copies cost n comparisons a turn, not n(n-1)/2.
* G1 is alternating large-star / small-star (Kiveris et al. 2014) over the
  edge DataFrame, written each round into ``spark.checkpoint.dir``; it
  stops on an exact test (every component is a star around its minimum).
* Hot keys (a very frequent token, a hub vertex, a huge component) are met
  with aggregations that combine map-side and AQE skew-join splitting; no
  window ever holds a whole component.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire import config as C
from tidewire.functions import text as T
from tidewire.session import ensure_checkpoint_dir, materialize


def token_sets(df: DataFrame, id_col: str = "id", text_col: str = "title") -> DataFrame:
    """P3 per row: (id, tokens sorted/distinct, n)."""
    toks = T.title_tokens(text_col)
    return df.select(F.col(id_col).alias("id"), toks.alias("tokens")).withColumn(
        "n", F.size("tokens").cast("bigint"))


def collapse_copies(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split non-empty token sets into (representatives, copy map).

    representatives: (rep, tokens, n, copies) — one row per distinct set.
    copy map: (id, rep) for every row with a non-empty set.
    The aggregation keys on the set itself (exact; the hash only speeds up
    the shuffle) and combines map-side, so a huge group of copies is cheap.
    """
    nonempty = sets.where(F.col("n") > 0).withColumn("_h", F.xxhash64("tokens"))
    reps = (nonempty.groupBy("_h", "tokens")
            .agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies")))
    cmap = nonempty.join(reps.select("_h", "tokens", "rep"), ["_h", "tokens"]).select("id", "rep")
    return reps.select("rep", "tokens", "n", "copies"), cmap


def _prefix_len(n: Column, num: int, den: int) -> Column:
    # n - ceil(num*n/den) + 1, in integers
    return n - F.floor((n * num + (den - 1)) / den).cast("bigint") + 1


#: 64-bit words of a set's bitmap; ``shared`` is the number of tokens in it.
_BITMAP = tuple(f"bits{i}" for i in range(8))
_SHAPE = ("shared", *_BITMAP)


def _bitmap() -> list[Column]:
    """Aggregates over ``tok``: a set's bitmap, in which each token flips the bit
    that its hash names."""
    h = F.xxhash64("tok")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"),
                          F.shiftright(h, 3).bitwiseAND(F.lit(63).cast("bigint")).cast("int"))
    at = h.bitwiseAND(F.lit(len(_BITMAP) - 1).cast("bigint"))
    return [F.bit_xor(F.when(at == i, bit).otherwise(F.lit(0).cast("bigint"))).alias(c) for i, c in enumerate(_BITMAP)]


def _overlaps(num: int, den: int) -> Column:
    """Whether the bitmaps of sets x and y leave room for the overlap of similar
    sets (exact bound): a bit that differs stands for at least one token that
    only one of them has."""
    apart = reduce(add, [F.bit_count(F.col(f"x_{c}").bitwiseXOR(F.col(f"y_{c}"))) for c in _BITMAP])
    return F.col("x_shared") + F.col("y_shared") - apart >= 2 * _overlap(F.col("x_n") + F.col("y_n"), num, den)


def postings(reps: DataFrame, num: int = C.JACCARD_NUM, den: int = C.JACCARD_DEN) -> DataFrame:
    """The inverted index of distinct token sets: one row per indexed token of
    a set, with ``rem``, the number of its tokens from this one on in global
    frequency order, and the bitmap of its tokens.  Tokens of one set only are
    left out: they meet nothing.

    ``reps`` has (rep, tokens, n) and may have further columns, which stay."""
    base = reps.where(F.col("n") > 0).withColumnRenamed("rep", "id")
    exploded = base.select("id", F.explode("tokens").alias("tok"))
    freq = exploded.groupBy("tok").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > 1)
    # order of the shared tokens; those of one set only come first in it anyway
    ranked = (exploded.join(freq, "tok").groupBy("id")
              .agg(F.array_sort(F.collect_list(F.struct("df", "tok"))).alias("ordered"), *_bitmap()))
    own = F.col("n") - F.size("ordered")  # tokens of this set only: the rarest
    indexed = F.greatest(_prefix_len(F.col("n"), num, den) - own, F.lit(0)).cast("int")
    return (base.join(ranked, "id")
            .select(*base.columns, F.size("ordered").alias("shared"), *_BITMAP,
                    F.posexplode(F.slice("ordered", 1, indexed)).alias("_pos", "_e"))
            .select(*base.columns, F.col("_e.tok").alias("tok"),
                    (F.col("shared") - F.col("_pos")).cast("bigint").alias("rem"), *_SHAPE))


def _up(x: Column, num: int, den: int) -> Column:
    """ceil(x * num / den) for whole numbers."""
    return F.floor((x * num + (den - 1)) / den).cast("bigint")


def _overlap(total: Column, num: int, den: int) -> Column:
    """Tokens that similar sets of ``total`` tokens share at least:
    ``t / (1 + t) * (n_a + n_b)``."""
    return _up(total, num, den + num)


def _needed(overlap: Column, most: Column, num: int, den: int) -> Column:
    """Postings that similar sets are asked to share.  They share no fewer than
    their overlap less the tokens in common behind the prefix of the set whose
    prefix ends first, at most ``ceil(t * n) - 1``; a quarter of that is asked, so
    that the postings counted may be bounded by their position as well."""
    return F.greatest(F.floor((overlap - _up(most, num, den) + 1) / 4).cast("bigint"), F.lit(1))


def _admissible(n_a: Column, rem_a: Column, n_b: Column, rem_b: Column, num: int, den: int) -> Column:
    """Whether a meeting on a token, with so many tokens of the sets from it on,
    counts (exact bounds, in integers):

    * length: ``min(n) >= t * max(n)``;
    * position (PPJoin): of the first ``needed`` tokens that similar sets share,
      each has at least ``overlap - needed + 1`` tokens of either set from it on.
      A similar pair keeps all of these meetings."""
    overlap = _overlap(n_a + n_b, num, den)
    return ((F.least(n_a, n_b) * den >= F.greatest(n_a, n_b) * num)
            & (F.least(rem_a, rem_b) > overlap - _needed(overlap, F.greatest(n_a, n_b), num, den)))


#: Sizes of one class differ by less than this factor.
_STEP = 1.2


def _magnitude(x: Column, shift: float = 0.0) -> Column:
    return F.floor(F.log(x) / F.lit(math.log(_STEP)) + shift).cast("int")


def classed(index: DataFrame) -> DataFrame:
    """Postings with their class: ``cn`` and ``cr``."""
    return index.withColumn("cn", _magnitude(F.col("n"))).withColumn("cr", _magnitude(F.col("rem")))


def _classes(index: DataFrame, by: tuple[str, ...], *more: Column) -> DataFrame:
    """The classes of each token with the bounds of their sets."""
    return index.groupBy("tok", *by).agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("rem").alias("rem"), *more)


def _class_pairs(classes: DataFrame, num: int, den: int) -> DataFrame:
    """Ordered pairs of a token's classes that can hold similar sets: the
    columns of ``classes`` for the first (a_...) and the second (b_...)."""
    a = classes.select(F.col("tok"), *[F.col(c).alias(f"a_{c}") for c in classes.columns if c != "tok"])
    b = classes.select(F.col("tok"), *[F.col(c).alias(f"b_{c}") for c in classes.columns if c != "tok"])
    return a.join(b, "tok").where(
        (F.col("a_hi") * den >= F.col("b_lo") * num) & (F.col("b_hi") * den >= F.col("a_lo") * num)
        & (F.least("a_rem", "b_rem") > _overlap(F.col("a_lo") + F.col("b_lo"), num, den) - _needed(
            _overlap(F.col("a_hi") + F.col("b_hi"), num, den), F.greatest("a_lo", "b_lo"), num, den)))


#: Postings of a token up to which they meet without regard to their classes.
DIRECT = 4096


def _side(index: DataFrame, side: str, carry: tuple[str, ...], mark: str = "", by: tuple[str, ...] = ()) -> DataFrame:
    """The postings as the sets x or y, with their classes as a or b."""
    return index.select("tok", *[F.col(c).alias(f"{side}_{c}") for c in carry], *[F.col(c).alias(f"{mark}_{c}") for c in by])


def _pass(num: int, den: int) -> Column:
    return _admissible(F.col("x_n"), F.col("x_rem"), F.col("y_n"), F.col("y_rem"), num, den) & _overlaps(num, den)


def _meet(index: DataFrame, by: tuple[str, ...], carry: tuple[str, ...], num: int, den: int,
          bounds: tuple[Column, ...] = (), can: Column | None = None, may: Column | None = None) -> DataFrame:
    """Sets that meet on a posting, once for each unordered pair of sets and
    posting, within the exact bounds.  ``may``: a condition on the two sets;
    ``can``: what follows from it for two classes with their ``bounds``."""
    carry = ("id", "n", "rem", *_SHAPE, *carry)
    passes = _pass(num, den) if may is None else may & _pass(num, den)
    often = index.groupBy("tok").agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") > DIRECT).select("tok")
    rare = index.join(often, "tok", "left_anti")
    direct = (_side(rare, "x", carry).join(_side(rare, "y", carry), "tok")
              .where((F.col("x_id") < F.col("y_id")) & passes))

    hot = index.join(often, "tok", "left_semi")
    pairs = _class_pairs(_classes(hot, by, *bounds), num, den)
    pairs = pairs if can is None else pairs.where(can)
    keys_a, keys_b = [f"a_{c}" for c in by], [f"b_{c}" for c in by]
    first, second = F.struct(*keys_a), F.struct(*keys_b)
    once = pairs.where(first <= second).select("tok", *keys_a, *keys_b).withColumn("_same", first == second)
    in_class = (_side(hot, "x", carry, "a", by).join(once, ["tok", *keys_a])
                .join(_side(hot, "y", carry, "b", by), ["tok", *keys_b])
                .where((~F.col("_same") | (F.col("x_id") < F.col("y_id"))) & passes))
    return direct.unionByName(in_class.select(*direct.columns))


def _counted(met: DataFrame, num: int, den: int, part: int = 1, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id_a < id_b, n_a, n_b, and ``carry``): pairs that meet on as many
    postings as similar sets of their sizes do; ``part``: an n-th of that is
    enough."""
    swap = F.col("x_id") > F.col("y_id")
    pairs = met.select(*[c for name in ("id", "n", *carry) for c in (
        F.when(swap, F.col(f"y_{name}")).otherwise(F.col(f"x_{name}")).alias(f"{name}_a"),
        F.when(swap, F.col(f"x_{name}")).otherwise(F.col(f"y_{name}")).alias(f"{name}_b"))])
    return (pairs.groupBy(*pairs.columns).agg(F.count(F.lit(1)).alias("_c"))
            .where(F.col("_c") * part >= _needed(_overlap(F.col("n_a") + F.col("n_b"), num, den),
                                                 F.greatest("n_a", "n_b"), num, den)).drop("_c"))


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose token sets (id, tokens) are similar, with ``n_inter``."""
    ta = sets.select(F.col("id").alias("id_a"), F.col("tokens").alias("t_a"))
    tb = sets.select(F.col("id").alias("id_b"), F.col("tokens").alias("t_b"))
    both = pairs.join(ta, "id_a").join(tb, "id_b").withColumn(
        "n_inter", F.size(F.array_intersect("t_a", "t_b")).cast("bigint")).drop("t_a", "t_b")
    return both.where(T.jaccard_passes("n_inter", "n_a", "n_b", num, den))


def similar_pairs(reps: DataFrame, num: int = C.JACCARD_NUM, den: int = C.JACCARD_DEN) -> DataFrame:
    """J3 over distinct token sets: (id_a < id_b, n_a, n_b, n_inter) for every
    pair with Jaccard >= num/den, exact.

    ``reps`` has (rep, tokens, n).  Output ids are the representatives.  Sets
    meet in admissible classes of an indexed token (``postings``), pairs with
    enough shared postings are verified on the full sets."""
    index = classed(postings(reps.select("rep", "tokens", "n"), num, den))
    met = _meet(index, ("cn", "cr"), (), num, den)
    return (_verified(_counted(met, num, den), reps.select(F.col("rep").alias("id"), "tokens"), num, den)
            .select("id_a", "id_b", "n_a", "n_b", "n_inter"))


# ---------------------------------------------------------------------------
# G1 connected components
# ---------------------------------------------------------------------------

def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(
        e.select(F.col("b").alias("x"), F.col("a").alias("y")))
    mins = both.groupBy("x").agg(F.min("y").alias("my"))
    return (both.join(mins, "x").where(F.col("y") > F.col("x"))
            .select(F.col("y").alias("a"), F.least("my", "x").alias("b")).distinct())


def _small_star(e: DataFrame) -> DataFrame:
    o = e.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y"))
    mins = o.groupBy("x").agg(F.min("y").alias("my"))
    linked = o.join(mins, "x").select(F.col("y").alias("a"), F.col("my").alias("b"))
    centers = mins.select(F.col("x").alias("a"), F.col("my").alias("b"))
    return linked.unionByName(centers).where(F.col("a") != F.col("b")).distinct()


def _is_star_forest(e: DataFrame) -> bool:
    """Exact fixed-point test on edges (a -> b, b < a): every leaf has one
    centre and no centre is a leaf -> every component is a star whose centre
    is its minimum."""
    marks = e.select(F.col("a").alias("v"), F.lit(1).alias("leaf"), F.lit(0).alias("ctr")).unionByName(
        e.select(F.col("b").alias("v"), F.lit(0).alias("leaf"), F.lit(1).alias("ctr")))
    per = marks.groupBy("v").agg(F.sum("leaf").alias("nl"), F.max("ctr").alias("c"))
    bad = per.where((F.col("nl") > 1) | ((F.col("nl") >= 1) & (F.col("c") == 1)))
    return bad.isEmpty()


def connected_components(edges: DataFrame, vertices: DataFrame | None = None, stars: bool = False) -> DataFrame:
    """G1: (id, component) with component = min id of the connected component.

    ``edges``: (a, b) undirected.  ``vertices``: optional (id) so that
    isolated vertices get their own id.  Lineage is cut every round by writing
    the edge table into the shared checkpoint folder (never a local one).
    ``stars``: the edges may well be stars already, which is tested first.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    e = (edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
         .where(F.col("a") != F.col("b")).distinct())
    # a round leaves a star forest unchanged, so the first round runs before
    # the first test (raw similarity edges are almost never already stars)
    if stars:
        e = materialize(e, "cc-edges")
    while not (stars and _is_star_forest(e)):
        e, stars = materialize(_small_star(_large_star(e)), "cc-edges"), True
    labels = e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        e.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
    if vertices is None:
        return labels
    return (vertices.select("id").distinct().join(labels, "id", "left")
            .select("id", F.coalesce("component", "id").alias("component")))


# ---------------------------------------------------------------------------
# G2 / W2 / A3
# ---------------------------------------------------------------------------

#: Cross-label pairs per posting from which on heads are compared first.
PAIRS_PER_POSTING = 4
_LABELLED = ("cn", "cr", "fresh")
#: A set meets the same head in one of so many of their common postings or more.
_HEAD_PART = 4


def _open(index: DataFrame) -> DataFrame:
    """Tokens whose postings span several labels: tok, postings, pairs (of
    postings under different labels)."""
    m = F.col("m").cast("decimal(19,0)")
    return (index.groupBy("tok", "label").agg(F.count(F.lit(1)).alias("m")).groupBy("tok")
            .agg(F.count(F.lit(1)).alias("labels"), F.sum("m").alias("postings"),
                 F.sum((m * F.col("m").cast("decimal(18,0)")).cast("decimal(37,0)")).alias("alike"))
            .where("labels > 1")
            .select("tok", "postings", ((F.col("postings").cast("decimal(19,0)") * F.col("postings").cast("decimal(18,0)")
                                         - F.col("alike")) / 2).cast("decimal(38,0)").alias("pairs")))


def _labels_of(pairs: DataFrame) -> DataFrame:
    """(a > b) labels of linked sets."""
    return pairs.select(F.greatest("label_a", "label_b").alias("a"), F.least("label_a", "label_b").alias("b")).distinct()


def _apart() -> Column:
    """Sets to compare: under different labels, one of them new."""
    return (F.col("x_label") != F.col("y_label")) & (F.col("x_fresh") | F.col("y_fresh"))


def _head_pairs(index: DataFrame, turn: int, num: int, den: int) -> DataFrame:
    """Each set with the head of its postings among sets of about its size; each
    turn has other heads and shifts the bounds between sizes by half a step."""
    carry = ("id", "n", "rem", "label", "fresh", *_SHAPE)
    sized = index.withColumn("_size", _magnitude(F.col("n"), 0.5 * turn))
    heads = (sized.groupBy("tok", "_size").agg(
        F.min_by(F.struct(*carry), F.xxhash64("id", F.lit(turn))).alias("h"),
        F.min("label").alias("_lo"), F.max("label").alias("_hi")).where(F.col("_lo") < F.col("_hi"))
        .select("tok", "_size", *[F.col(f"h.{c}").alias(f"y_{c}") for c in carry]))
    met = (sized.select("tok", "_size", *[F.col(c).alias(f"x_{c}") for c in carry])
           .join(heads, ["tok", "_size"]).where(_apart() & _pass(num, den)))
    return _counted(met, num, den, _HEAD_PART, ("label",))


def _all_pairs(index: DataFrame, num: int, den: int) -> DataFrame:
    """All pairs under different labels that can be similar."""
    met = _meet(index, _LABELLED, ("label", "fresh"), num, den,
                (F.min("label").alias("l_lo"), F.max("label").alias("l_hi")),
                (F.col("a_fresh") | F.col("b_fresh")) & (F.least("a_l_lo", "b_l_lo") < F.greatest("a_l_hi", "b_l_hi")), _apart())
    return _counted(met, num, den, 1, ("label",))


def _relabel(df: DataFrame, roots: DataFrame) -> DataFrame:
    moved = roots.where(F.col("id") != F.col("component")).select(F.col("id").alias("label"), "component")
    return (df.join(moved, "label", "left")
            .withColumn("label", F.coalesce("component", "label")).drop("component").select(*df.columns))


def link_labels(reps: DataFrame, num: int = C.JACCARD_NUM, den: int = C.JACCARD_DEN) -> DataFrame:
    """(label, root) for every label of ``reps``: labels that similar sets
    connect share the least of them.

    ``reps`` has (rep, tokens, n, label, fresh): distinct token sets, the label
    each stands under, and whether it is new; two sets that are not fresh are
    not compared.  Exact: heads only save comparisons, and what they leave
    under different labels is joined in full.  That last join grows with the
    pairs that pass every bound and yet are not similar."""
    roots = reps.select("label", F.col("label").alias("root")).distinct()
    sets = reps.select(F.col("rep").alias("id"), "tokens")
    index = materialize(classed(postings(reps, num, den).drop("tokens")), "postings")
    turn, before = 0, None
    while True:
        several = materialize(_open(index), "open")
        left = several.agg(F.sum("pairs").alias("pairs"), F.sum("postings").alias("postings")).first()
        if left.pairs is None:
            return roots
        few = left.pairs <= PAIRS_PER_POSTING * left.postings
        slow = before is not None and left.pairs * 10 > before * 7
        here = index.join(several.select("tok"), "tok", "left_semi")
        if few or slow:
            pairs = _all_pairs(here, num, den)
        else:
            here = materialize(here, "postings") if turn else index
            pairs = _head_pairs(here, turn, num, den)
        found = connected_components(materialize(_labels_of(_verified(pairs, sets, num, den)), "links"))
        # the labels of every set follow; the table has one row a label
        roots = (roots.join(found.select(F.col("id").alias("root"), "component"), "root", "left")
                 .select("label", F.coalesce("component", "root").alias("root")))
        if few or slow:
            return roots
        roots = materialize(roots, "roots")
        index = materialize(_relabel(here, found), "postings")
        turn, before = turn + 1, left.pairs


def group_titles(rows: DataFrame, num: int = C.JACCARD_NUM, den: int = C.JACCARD_DEN,
                 title_col: str = "title", some_stored: bool = False) -> DataFrame:
    """(id, story_group_id) for rows of (id, title, label, fresh): labels whose
    rows have similar titles become one, the least of them.  Rows with an empty
    token set keep their label.  ``some_stored``: not all rows are fresh."""
    sets = (rows.select("id", "label", "fresh", T.title_tokens(title_col).alias("tokens"))
            .withColumn("n", F.size("tokens").cast("bigint")).withColumn("_h", F.xxhash64("tokens")))
    # one representative per distinct set: equal titles share its label.  The
    # distinct sets feed the frequency order, the index and the copies, so they
    # are written once instead of tokenised for each
    reps = materialize(sets.where(F.col("n") > 0).groupBy("_h", "tokens").agg(
        F.min("id").alias("rep"), F.first("n").alias("n"), F.min("label").alias("label"),
        F.min("fresh").alias("fresh")), "title-sets")
    tied = sets.join(reps.select("_h", "tokens", F.col("label").alias("_set")), ["_h", "tokens"], "left")
    if some_stored:
        # a stored label found on a copy of another label's title joins that label
        held = tied.where(~F.col("fresh") & (F.col("label") != F.col("_set")))
        joined = connected_components(held.select(F.col("label").alias("a"), F.col("_set").alias("b")))
        reps = _relabel(reps, joined)
    roots = link_labels(reps.select("rep", "tokens", "n", "label", "fresh"), num, den)
    if some_stored:
        first = joined.select(F.col("id").alias("label"), F.col("component").alias("_first"))
        roots = (first.join(roots.withColumnRenamed("label", "_first"), "_first")
                 .select("label", "root")).unionByName(roots).distinct()
    own = F.when(F.col("fresh"), F.coalesce("_set", "label")).otherwise(F.col("label"))
    return (tied.select("id", own.alias("label")).join(roots, "label", "left")
            .select("id", F.coalesce("root", "label").alias("story_group_id")))


def story_components(articles: DataFrame, num: int = C.JACCARD_NUM, den: int = C.JACCARD_DEN,
                     title_col: str = "title") -> DataFrame:
    """J3 + G1 over article titles: (id, story_group_id) for every input row;
    the component label is the minimum article id."""
    rows = articles.select("id", title_col, F.col("id").alias("label"), F.lit(True).alias("fresh"))
    return group_titles(rows, num, den, title_col)


def choose_anchors(members: DataFrame, group_col: str = "story_group_id") -> DataFrame:
    """The member with the longest summary (NULL = 0) is the anchor; the
    lowest id wins ties; all others get ``is_duplicate = 1``.  ``group_size``
    (A2) comes from the same aggregation.

    Per-group max of a (length, -id) struct: combines map-side, so a huge
    component is never gathered into one task; the result joins back on the
    group key (one row per group on the build side)."""
    slen = F.col("summary_len") if "summary_len" in members.columns else \
        F.length(F.coalesce(F.col("summary"), F.lit("")))
    best = (members.groupBy(group_col)
            .agg(F.max(F.struct(slen.alias("l"), (-F.col("id")).alias("nid"))).alias("_b"),
                 F.count(F.lit(1)).alias("group_size"))
            .select(group_col, "group_size", (-F.col("_b.nid")).alias("_anchor")))
    return (members.join(best, group_col)
            .withColumn("is_duplicate", (F.col("id") != F.col("_anchor")).cast("int"))
            .drop("_anchor"))


def _cutoff(as_of: Column, lookback_hours: int) -> Column:
    return F.timestamp_seconds(F.unix_seconds(as_of) - lookback_hours * 3600)


def _narrow(df: DataFrame) -> DataFrame:
    if "summary_len" not in df.columns:
        df = df.withColumn("summary_len", F.length(F.coalesce(F.col("summary"), F.lit(""))))
    return df.drop(*[c for c in C.BULKY_COLUMNS if c in df.columns])


def window_narrow(articles: DataFrame, as_of: Column, lookback_hours: int = C.LOOKBACK_HOURS) -> DataFrame:
    """F4 + F5: ungrouped rows fetched inside the look-back window, bulky
    text replaced by ``summary_len``, materialised once in the checkpoint
    folder (reliable checkpoint: survives executor loss, cuts lineage)."""
    ensure_checkpoint_dir(articles.sparkSession)
    win = articles.where(F.col("fetched_at") >= _cutoff(as_of, lookback_hours))
    if "story_group_id" in win.columns:
        win = win.where(F.col("story_group_id").isNull()).drop("story_group_id", "is_duplicate")
    return materialize(_narrow(win), "window")


def story_groups(articles: DataFrame, as_of: Column, lookback_hours: int = C.LOOKBACK_HOURS,
                 mode: str = "new_only") -> DataFrame:
    """G2 (with F4, F5, G3): group the ungrouped articles fetched inside the
    look-back window; returns those rows with ``story_group_id``,
    ``is_duplicate`` and ``group_size``.

    ``mode="new_only"`` compares only ungrouped rows (late copies never join an
    old group), as the reference does.  ``mode="attach"`` is ``attach_groups``.

    The window is materialised once as a narrow table (bulky text columns
    replaced by ``summary_len``) in the checkpoint folder: the similarity
    join, the component rounds and the anchor choice all read it, and the
    upstream ingest is not recomputed for each of them; the grouped rows are
    narrow as well and written once, as several later steps read them.  Join
    the result back on ``id`` when the text columns are needed."""
    if mode == "attach":
        return attach_groups(articles, as_of, lookback_hours)
    if mode != "new_only":
        raise ValueError(f"unknown mode {mode!r}")
    narrow = window_narrow(articles, as_of, lookback_hours)
    comps = story_components(narrow)
    return materialize(choose_anchors(narrow.join(comps, "id")), "grouped")


def attach_groups(articles: DataFrame, as_of: Column, lookback_hours: int = C.LOOKBACK_HOURS) -> DataFrame:
    """G3 ``attach``: ungrouped rows of the look-back window are compared with
    each other and with the window's grouped rows, whose groups they join or
    merge (the least label stays); grouped rows are not compared again.

    Returns the updates to the store: the new rows, and all rows of groups that
    gained a row or were merged, also those fetched before the window, with
    their ``story_group_id``, ``is_duplicate`` and ``group_size``; apply them by
    ``io.keyed_update`` on ``id``.  As long as rows stay in the window, grouping
    them in any split gives what grouping at once gives."""
    ensure_checkpoint_dir(articles.sparkSession)
    label = F.coalesce("story_group_id", "id")
    win = materialize(articles.where(F.col("fetched_at") >= _cutoff(as_of, lookback_hours)).select(
        "id", "title", label.alias("label"), F.col("story_group_id").isNull().alias("fresh")), "window")
    placed = materialize(win.select("id", "label", "fresh").join(
        group_titles(win, some_stored=True).withColumnRenamed("story_group_id", "group"), "id"), "placed")
    moved = ~F.col("fresh") & (F.col("label") != F.col("group"))
    touched = (placed.groupBy("group").agg(F.max(F.col("fresh") | moved).alias("changed"))
               .where("changed").select("group"))
    moves = placed.where(~F.col("fresh")).select(F.col("label").alias("story_group_id"), "group").distinct()
    rows = _narrow(articles.drop(*[c for c in ("is_duplicate", "group_size") if c in articles.columns]))
    new = rows.where(F.col("story_group_id").isNull()).join(placed.where("fresh").select("id", "group"), "id")
    old = rows.join(moves.join(touched, "group", "left_semi"), "story_group_id")
    members = new.unionByName(old.select(*new.columns)).drop("story_group_id").withColumnRenamed("group", "story_group_id")
    return materialize(choose_anchors(members), "attached")


def group_stats(grouped: DataFrame) -> DataFrame:
    """A3: per story group with more than one member: members, distinct
    sources, multi-source flag, duplicates."""
    g = grouped.groupBy("story_group_id").agg(
        F.count(F.lit(1)).alias("members"),
        F.count_distinct("source").alias("n_sources"),
        F.sum("is_duplicate").cast("bigint").alias("duplicates"))
    return (g.where(F.col("members") > 1)
            .withColumn("multi_source", F.col("n_sources") > 1))
