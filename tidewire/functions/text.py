"""String column expressions.

All expressions are Catalyst built-ins, so they run inside whole-stage codegen
with no Python worker.  Java regexes need ``(?U)`` for ``\\s`` to match the
Unicode whitespace set that Python's ``str.split``/``strip`` use.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire import config as C

_WS = "(?U)\\s"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def url_hash(url) -> Column:
    """Hex SHA-256 of the UTF-8 url."""
    return F.sha2(_c(url), 256)


def strip_ws(x) -> Column:
    """Remove leading/trailing Unicode whitespace (``trim`` only drops spaces)."""
    return F.regexp_replace(_c(x), f"^{_WS}+|{_WS}+$", "")


def title_tokens(x) -> Column:
    """Lower-case; every char outside ``a-z0-9 `` becomes a space; words of
    at least three chars; a sorted set (array without repeats)."""
    cleaned = F.regexp_replace(F.lower(F.coalesce(_c(x), F.lit(""))), "[^a-z0-9 ]", " ")
    words = F.filter(F.split(cleaned, " "), lambda w: F.length(w) >= C.MIN_TOKEN_LEN)
    return F.array_sort(F.array_distinct(words))


def jaccard_passes(inter, n_a, n_b, num: int = C.JACCARD_NUM, den: int = C.JACCARD_DEN) -> Column:
    """P4 as an exact integer test: inter / (n_a + n_b - inter) >= num/den.
    Empty sets never pass (their Jaccard is defined as 0)."""
    inter, n_a, n_b = _c(inter), _c(n_a), _c(n_b)
    union = n_a + n_b - inter
    return (n_a > 0) & (n_b > 0) & (inter * den >= union * num)


def jaccard(a, b) -> Column:
    """|A∩B| / |A∪B| over two token arrays, 0.0 when either is empty."""
    a, b = _c(a), _c(b)
    inter = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(inter / union)


def clean_text(x) -> Column:
    """P5: tags -> space, whitespace runs -> one space, stripped."""
    no_tags = F.regexp_replace(F.coalesce(_c(x), F.lit("")), "<[^>]+>", " ")
    return strip_ws(F.regexp_replace(no_tags, f"{_WS}+", " "))


def html_to_readable(x) -> Column:
    """Headings -> ``\\n### ``, block closers/``<p>``/``<br>`` -> newline,
    other tags dropped, 3+ newlines -> 2, stripped."""
    t = F.coalesce(_c(x), F.lit(""))
    t = F.regexp_replace(t, "<h[1-6][^>]*>", "\n### ")
    t = F.regexp_replace(t, "</h[1-6]>", "\n")
    t = F.regexp_replace(t, "<p[^>]*>", "\n")
    t = F.regexp_replace(t, "</p>", "\n")
    t = F.regexp_replace(t, f"<br{_WS}*/?>", "\n")
    t = F.regexp_replace(t, "<[^>]+>", "")
    t = F.regexp_replace(t, "\n{3,}", "\n\n")
    return strip_ws(t)


def word_count(x) -> Column:
    """Tags -> space, then the number of whitespace-separated words."""
    no_tags = F.regexp_replace(F.coalesce(_c(x), F.lit("")), "<[^>]+>", " ")
    return F.size(F.filter(F.split(no_tags, f"{_WS}+"), lambda w: w != "")).cast("bigint")


def decode_entities(x) -> Column:
    """Drop tags, then the digest entity replacements in their fixed order
    (``&amp;`` before ``&lt;``, so ``&amp;lt;`` ends as ``<``), stripped."""
    t = F.regexp_replace(F.coalesce(_c(x), F.lit("")), "<[^>]+>", "")
    for entity, char in C.DIGEST_ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(char))
    return strip_ws(t)


def truncate_word(x, n: int = C.DIGEST_TRUNCATE) -> Column:
    """Unchanged up to n chars; else cut at n, drop from the last space on,
    append ``...`` (hard cut when the first n chars hold no space)."""
    x = _c(x)
    cut = F.regexp_replace(F.substring(x, 1, n), " [^ ]*$", "")
    return F.when(F.length(x) <= n, x).otherwise(F.concat(cut, F.lit("...")))


def substr_cap(x, n: int) -> Column:
    """P10: first n characters (code points)."""
    return F.substring(_c(x), 1, n)


def first_paragraph(x) -> Column:
    """First line, stripped ('' when blank)."""
    return strip_ws(F.substring_index(F.coalesce(_c(x), F.lit("")), "\n", 1))


def title_case(x) -> Column:
    """Single-word title case."""
    return F.initcap(_c(x))


def url_domain(url) -> Column:
    """Network location (userinfo/port kept), lower-cased, one leading
    ``www.`` removed; '' when the text has no ``//authority`` part."""
    netloc = F.regexp_extract(F.coalesce(_c(url), F.lit("")),
                              "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    return F.regexp_replace(F.lower(netloc), "^www\\.", "")


def headline_words(x, k: int = 3, min_len: int = 4) -> Column:
    """Whitespace words longer than ``min_len`` chars, first ``k``."""
    words = F.split(F.coalesce(_c(x), F.lit("")), f"{_WS}+")
    return F.slice(F.filter(words, lambda w: F.length(w) > min_len), 1, k)
