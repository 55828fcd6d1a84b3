"""Classification and scoring column expressions.

The taxonomy is a small config list; it is inlined as literal expressions so
classification is a per-row projection inside codegen — no join, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire import config as C


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, fn) -> Column:
    """Bind ``value`` once and evaluate ``fn(bound)``.

    Catalyst substitutes a projected alias into every reference when it pushes
    a filter below the projection, so an expensive shared input (the lowered
    article text) would be recomputed once per keyword test.  A lambda over a
    one-element array evaluates the input exactly once, wherever it lands."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def topic_text(title, summary) -> Column:
    return F.lower(F.concat_ws(" ", F.coalesce(_c(title), F.lit("")), F.coalesce(_c(summary), F.lit(""))))


def category_hits(text, taxonomy=C.TAXONOMY) -> Column:
    """Per category (config order) the number of its keyword entries that occur
    as substrings of ``text`` — an array<struct<cat_ord, category, hits>>."""

    def build(t: Column) -> Column:
        items = []
        for i, (cat, kws) in enumerate(taxonomy):
            hits = sum((F.instr(t, kw) > 0).cast("int") for kw in kws) if kws else F.lit(0)
            items.append(F.struct(F.lit(i + 1).alias("cat_ord"), F.lit(cat).alias("category"),
                                  hits.alias("hits")))
        return F.array(*items)
    return let(_c(text), build)


def categorise(title, summary, taxonomy=C.TAXONOMY) -> Column:
    """A1: category with most keyword hits; the first in config order wins a
    tie; no hit at all -> the fallback category."""
    return categorise_text(topic_text(title, summary), taxonomy)


def categorise_text(text, taxonomy=C.TAXONOMY) -> Column:
    """A1 over an already lower-cased topic text."""
    return best_category(category_hits(text, taxonomy))


def best_category(hits) -> Column:
    """argmax over category_hits: most hits, first in config order on ties."""
    hits = _c(hits)
    best = F.array_min(F.transform(hits, lambda s: F.struct((-s["hits"]).alias("neg"), s["cat_ord"].alias("o"),
                                                            s["category"].alias("c"))))
    return F.when(best["neg"] < 0, best["c"]).otherwise(F.lit(C.FALLBACK_CATEGORY))


def is_relevant(title, summary, taxonomy=C.TAXONOMY) -> Column:
    """at least one keyword of any category is a substring (no word bounds)."""
    return is_relevant_text(topic_text(title, summary), taxonomy)


def is_relevant_text(text, taxonomy=C.TAXONOMY) -> Column:
    """F3 over an already lower-cased topic text."""
    kws = sorted({kw for _, ks in taxonomy for kw in ks})
    if not kws:
        return F.lit(False)

    def any_hit(t: Column) -> Column:
        tests = [F.instr(t, kw) > 0 for kw in kws]
        out = tests[0]
        for x in tests[1:]:
            out = out | x
        return out
    return let(_c(text), any_hit)


def recency_score(published, as_of) -> Column:
    """M1: < 6 h old (future counts as fresh) 1.0, older 0.5, unknown 0.3."""
    published, as_of = _c(published), _c(as_of)
    age_us = F.unix_micros(as_of) - F.unix_micros(published)
    return (F.when(published.isNull(), F.lit(C.RECENCY_UNKNOWN))
            .when(age_us < F.lit(C.RECENT_HOURS * 3600 * 1_000_000), F.lit(C.RECENCY_FRESH))
            .otherwise(F.lit(C.RECENCY_OLD)))


def authority_score(weight) -> Column:
    """M2: looked-up weight or the default."""
    return F.coalesce(_c(weight), F.lit(C.DEFAULT_AUTHORITY))


def group_bonus(group_size) -> Column:
    """M3: bonus when the story group holds more than one article."""
    return F.when(F.coalesce(_c(group_size), F.lit(1)) > 1, F.lit(C.GROUP_BONUS)).otherwise(F.lit(0.0))


def category_boost(category, boosted=C.BOOSTED_CATEGORIES) -> Column:
    """M4."""
    return F.when(_c(category).isin(list(boosted)), F.lit(C.CATEGORY_BOOST)).otherwise(F.lit(0.0))


def priority_score(recency, authority, bonus, boost) -> Column:
    """M5: the four parts summed in this order, rounded to 3 places."""
    return F.round(_c(recency) + _c(authority) + _c(bonus) + _c(boost), 3)


def _template(template: str, raw: Column) -> Column:
    head, tail = template.split("{raw}")
    return F.concat(F.lit(head), raw, F.lit(tail))


def validate_override(raw) -> Column:
    """M8: struct<key, err> for a category-override cell.

    blank or a home-section word -> (NULL, NULL); a human-only section ->
    error; an unknown value -> error listing the valid ones; else the key."""
    shown = F.regexp_replace(F.coalesce(_c(raw), F.lit("")), "(?U)^\\s+|\\s+$", "")
    norm = F.lower(shown)
    blocked_err = _template(C.OVERRIDE_BLOCKED_MSG, shown)
    unknown_err = _template(C.OVERRIDE_UNKNOWN_MSG, shown)
    null = F.lit(None).cast("string")
    home = (norm == "") | norm.isin(C.OVERRIDE_HOME_WORDS)
    key = F.when(home, null).when(norm.isin(C.OVERRIDE_BLOCKED), null) \
        .when(~norm.isin(C.OVERRIDE_VALID), null).otherwise(norm)
    err = F.when(home, null).when(norm.isin(C.OVERRIDE_BLOCKED), blocked_err) \
        .when(~norm.isin(C.OVERRIDE_VALID), unknown_err).otherwise(null)
    return F.struct(key.alias("key"), err.alias("err"))


def draft_category(override_key, model_category) -> Column:
    """A valid override (title-cased) wins over the model's category."""
    return F.coalesce(F.initcap(_c(override_key)), _c(model_category))
