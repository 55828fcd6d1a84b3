"""Link requests: F9, P13, M7/J13 URL type, M8, M9 outcome, X9 main text,
X10 embed text, X13 skip notices.

The fetch itself is external: pages arrive as a (url, html) table and fetch
outcomes as (url, http_status, error).  Everything else is one DataFrame job:
no per-row control flow, every branch is a column of the outcome."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire import config as C
from tidewire.functions import scoring as S
from tidewire.functions import text as T
from tidewire.session import ship_package

KIND_PRIORITY = {"twitter": 1, "blocked_social": 2, "paywall": 3}

# Outcome texts.
SKIP_SOCIAL = "Skipped — social post, needs a page link"
SKIP_SOCIAL_REASON = "Social post: no page text to read; give the page it points to."
SKIP_PAYWALL = "Skipped — subscribers only: {label}"
SKIP_PAYWALL_REASON = "{label} shows its text to subscribers only; give an open page."
SKIP_BLOCKED = "Skipped — access refused by the site"
SKIP_BLOCKED_REASON = "The site refuses programs; give a page of another site."
NO_CONTAINER = "No text container on the page."
NO_POST_TEXT = "The embed holds no post text."


def pending_requests(sheet: DataFrame, terminal: str = "exact") -> DataFrame:
    """S11 + F9: stripped cells; url non-empty and status not a done word
    (exact match by default, so long outcome texts stay pending)."""
    st = F.lower(T.strip_ws(F.coalesce(F.col("status"), F.lit(""))))
    done = st.isin(C.REQUEST_DONE_STATUSES) if terminal == "exact" else \
        F.exists(F.array(*[F.lit(w) for w in C.REQUEST_DONE_STATUSES]), lambda w: st.startswith(w))
    url = T.strip_ws(F.coalesce(F.col("url"), F.lit("")))
    return (sheet.select("row_ord", url.alias("url"),
                         T.strip_ws(F.coalesce(F.col("notes"), F.lit(""))).alias("notes"),
                         F.col("status"),
                         T.strip_ws(F.coalesce(F.col("category_override"), F.lit(""))).alias("category_override"))
            .where((F.col("url") != "") & ~done))


#: Domain names have at most 127 labels.
_MOST_LABELS = 127


def domain_types(domains: DataFrame, rules: DataFrame) -> DataFrame:
    """(domain, kind, label) for the distinct ``domain``s that a rule
    matches: exact rules the full domain, suffix rules it or any dot-suffix.
    The best is by kind priority, then rule order (``rule_ord`` where the rules
    have it, else the rule's domain).

    A domain is cut only at the numbers of labels that suffix rules have, so
    unless there is a rule ``com`` no domain is looked up under ``com``.  Those
    numbers are one row of at most 127 small integers, whatever the rules."""
    priority = F.create_map(*[x for k, p in KIND_PRIORITY.items() for x in (F.lit(k), F.lit(p))])
    order = F.col("rule_ord") if "rule_ord" in rules.columns else F.col("domain")
    r = rules.select("domain", F.struct(F.element_at(priority, F.col("kind")).alias("pri"), order.alias("ord"),
                                        F.col("kind").alias("kind"), F.col("label").alias("label")).alias("rule"),
                     (F.col("match") == "suffix").alias("suffix"))
    # one rule for each looked-up name and form
    best = r.groupBy(F.col("domain").alias("name"), "suffix").agg(F.min("rule").alias("rule"))
    labels = F.size(F.split("domain", "[.]"))
    depths = (r.where("suffix").agg(F.collect_set(F.least(labels, F.lit(_MOST_LABELS))).alias("depths")))
    parts = F.split("domain", "[.]")
    cut = (domains.select("domain").distinct().withColumn("depths", depths.scalar())
           .select("domain", F.explode(F.transform(
               F.filter("depths", lambda k: k <= F.size(parts)),
               lambda k: F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "."))).alias("name"))
           .withColumn("suffix", F.lit(True)))
    whole = domains.select("domain").distinct().select("domain", F.col("domain").alias("name"), F.lit(False).alias("suffix"))
    return (cut.unionByName(whole).join(best, ["name", "suffix"])
            .groupBy("domain").agg(F.min("rule").alias("rule")).select("domain", "rule.kind", "rule.label"))


def url_types(requests: DataFrame, rules: DataFrame, key: str = "row_ord") -> DataFrame:
    """M7 + J13: (key, domain, url_type, label); no match -> ``article``.
    Rules are looked up once a distinct domain."""
    d = requests.select(key, T.url_domain("url").alias("domain"))
    return (d.join(domain_types(d, rules), "domain", "left")
            .select(key, "domain", F.coalesce("kind", F.lit("article")).alias("url_type"),
                    F.coalesce("label", F.lit("")).alias("label")))


# ---------------------------------------------------------------------------
# X9 main-text extraction (the one Python step: vectorised mapInPandas)
# ---------------------------------------------------------------------------

_WS = re.compile(r"\s+")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
         "param", "source", "track", "wbr"}


class _Extractor(HTMLParser):
    """One pass over a page: text of the first h1 / title, paragraphs and all
    text of the first article / main / body container, noise tags skipped."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.noise: int | None = None   # where in the stack the outermost noise element is
        self.h1: list[str] | None = None
        self.h1_done = False
        self.title: list[str] | None = None
        self.title_done = False
        self.containers: dict[str, list] = {}   # tag -> [depth, pieces, paragraphs, done]
        self.p: list[str] | None = None
        self.p_owner: list = []
        self.stack: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            return
        if tag in C.NOISE_TAGS and self.noise is None:
            self.noise = len(self.stack)
        if self.noise is not None:
            self.stack.append(tag)
            return
        if tag == "p":
            self._close_p()
            self.p = []
            self.p_owner = [c for c in self.containers.values() if not c[3]]
        if tag == "h1" and self.h1 is None:
            self.h1 = []
        if tag == "title" and self.title is None:
            self.title = []
        if tag in ("article", "main", "body") and tag not in self.containers:
            self.containers[tag] = [len(self.stack), [], [], False]
        self.stack.append(tag)

    def handle_endtag(self, tag):
        if self.noise is not None:
            # an unclosed noise element ends with the element around it
            if tag not in self.stack:
                return
            at = len(self.stack) - 1 - self.stack[::-1].index(tag)
            if at >= self.noise:
                del self.stack[at:]
                if at == self.noise:
                    self.noise = None
                return
            del self.stack[self.noise:]
            self.noise = None
        if tag == "p":
            self._close_p()
        if tag == "h1" and self.h1 is not None:
            self.h1_done = True
        if tag == "title" and self.title is not None:
            self.title_done = True
        if tag in self.stack:
            while self.stack:
                t = self.stack.pop()
                if t in self.containers and len(self.stack) == self.containers[t][0] and not self.containers[t][3]:
                    self._close_p()
                    self.containers[t][3] = True
                if t == tag:
                    break

    def _close_p(self):
        if self.p is not None:
            text = " ".join(self.p)
            for c in self.p_owner:
                c[2].append(text)
        self.p = None
        self.p_owner = []

    def handle_data(self, data):
        if self.noise is not None:
            return
        piece = data.strip()
        if not piece:
            return
        if self.h1 is not None and not self.h1_done:
            self.h1.append(piece)
        if self.title is not None and not self.title_done:
            self.title.append(piece)
        for c in self.containers.values():
            if not c[3]:
                c[1].append(piece)
        if self.p is not None:
            self.p.append(piece)

    def result(self) -> tuple[str, str | None, str | None]:
        self._close_p()
        title = "".join(self.title or []) if self.h1 is None else "".join(self.h1)
        for tag in ("article", "main", "body"):
            if tag in self.containers:
                c = self.containers[tag]
                body = "\n\n".join(p for p in c[2] if len(p) > C.MIN_PARAGRAPH_CHARS)
                if len(body) < C.MIN_BODY_CHARS:
                    body = _WS.sub(" ", " ".join(c[1]))
                return title, body, None
        return title, None, NO_CONTAINER


def extract_page(html: str | None) -> tuple[str, str | None, str | None]:
    """X9 on one page -> (title, body, error)."""
    p = _Extractor()
    try:
        p.feed(html or "")
        p.close()
    except Exception as e:  # noqa: BLE001  (malformed markup: report, do not fail the job)
        return "", None, f"parse error: {e}"
    return p.result()


EXTRACT_SCHEMA = "url string, title string, body string, error string"


def _extract_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        res = [extract_page(h) for h in pdf["html"]]
        yield pd.DataFrame({"url": pdf["url"].values,
                            "title": [r[0] for r in res],
                            "body": [r[1] for r in res],
                            "error": [r[2] for r in res]})


def extract_main_text(pages: DataFrame) -> DataFrame:
    """X9 over a pages table: Arrow batches through ``mapInPandas``.  Filter
    the pages first (Catalyst cannot push a filter through this step)."""
    ship_package(pages.sparkSession)
    return pages.select("url", "html").mapInPandas(_extract_batches, EXTRACT_SCHEMA)


# ---------------------------------------------------------------------------
# X10 embed text
# ---------------------------------------------------------------------------

# Named entities of XML and the most used ones of HTML (fixed values).
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&mdash;", "—"),
             ("&ndash;", "–"), ("&hellip;", "…"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"))


def unescape_entities(text: Column) -> Column:
    """Character references by number and the entities above; ``&amp;`` last, so
    that an escaped reference stays a reference."""
    def one(m: Column) -> Column:
        number = F.when(m.startswith("x") | m.startswith("X"), F.conv(F.substring(m, 2, 8), 16, 10)).otherwise(m)
        code = number.try_cast("int")
        # a code point as UTF-32, big-endian
        return F.when((code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF),
                      F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.concat(F.lit("&#"), m, F.lit(";")))

    parts = F.split(text, "&#(?=[0-9]{1,7};|[xX][0-9a-fA-F]{1,6};)")
    by_number = F.array_join(F.transform(parts, lambda part, i: F.when(i == 0, part).otherwise(F.concat(
        one(F.substring_index(part, ";", 1)), F.substr(part, F.instr(part, ";") + 1)))), "")
    for entity, char in _ENTITIES:
        by_number = F.replace(by_number, F.lit(entity), F.lit(char))
    return F.replace(by_number, F.lit("&amp;"), F.lit("&"))


def embed_text(embeds: DataFrame) -> DataFrame:
    """Text of the first ``<p>`` and ``Name (@handle)`` (handle = last
    path part of the author URL); empty text is a failure."""
    p = F.regexp_extract(F.col("html"), "(?s)<p[^>]*>(.*?)</p>", 1)
    plain = unescape_entities(F.regexp_replace(p, "<[^>]+>", " "))
    text = T.strip_ws(F.regexp_replace(plain, "(?U)\\s+", " "))
    handle = F.substring_index(F.regexp_replace(F.coalesce(F.col("author_url"), F.lit("")), "/+$", ""), "/", -1)
    author = F.when(F.coalesce(F.col("author_name"), F.lit("")) != "",
                    F.concat(F.col("author_name"), F.lit(" (@"), handle, F.lit(")"))).otherwise(F.lit(""))
    return embeds.select("url", author.alias("author_line"), text.alias("text"),
                         F.when(text == "", F.lit(NO_POST_TEXT)).alias("error"))


# ---------------------------------------------------------------------------
# M9 outcome per request, X13 notices
# ---------------------------------------------------------------------------

def _fill(template: str, label: Column) -> Column:
    head, tail = template.split("{label}")
    return F.concat(F.lit(head), label, F.lit(tail))


def last_fetch(fetches: DataFrame) -> DataFrame:
    """One outcome a URL.  A fetch is tried again after a failure, so a success
    counts if there is one; among equals the last try (``try_ord`` where the
    table has it), then the highest status."""
    good = F.col("error").isNull() & (F.coalesce("http_status", F.lit(0)) < 400)
    tried = F.col("try_ord") if "try_ord" in fetches.columns else F.lit(0)
    best = F.max(F.struct(good.alias("good"), tried.alias("ord"), F.col("http_status"), F.col("error")))
    return fetches.groupBy("url").agg(best.alias("b")).select("url", "b.http_status", "b.error")


def _one_a_url(rows: DataFrame, error: str) -> DataFrame:
    """One row a URL, one without error if there is such."""
    rest = [c for c in rows.columns if c != "url"]
    best = F.min(F.struct(F.col(error).isNotNull().alias("_bad"), *rest))
    return rows.groupBy("url").agg(best.alias("b")).select("url", *[f"b.{c}" for c in rest])


def request_outcomes(pending: DataFrame, rules: DataFrame, fetches: DataFrame,
                     extracted: DataFrame, embedded: DataFrame) -> DataFrame:
    """M9: one outcome per pending request, checked in order: bad override,
    social link, paywall, access denied (401/403), other fetch failure,
    extraction failure, else processed.  Skips also carry a notice reason."""
    ov = pending.withColumn("_ov", S.validate_override("category_override"))
    typed = ov.join(url_types(pending, rules), "row_ord")
    f = last_fetch(fetches).select("url", "http_status", F.col("error").alias("fetch_error"))
    x = _one_a_url(extracted.select("url", F.col("error").alias("extract_error"), F.col("title").alias("page_title"),
                                    F.lit(True).alias("_has_page")), "extract_error")
    e = _one_a_url(embedded.select("url", F.col("error").alias("embed_error"), "author_line",
                                   F.lit(True).alias("_has_embed")), "embed_error")
    j = typed.join(f, "url", "left").join(x, "url", "left").join(e, "url", "left")
    t = F.col("url_type")
    status = (F.when(F.col("_ov.err").isNotNull(), F.col("_ov.err"))
              .when(t == "blocked_social", F.lit(SKIP_SOCIAL))
              .when(t == "paywall", _fill(SKIP_PAYWALL, F.col("label")))
              .when((t != "twitter") & F.col("http_status").isin(401, 403), F.lit(SKIP_BLOCKED))
              .when((t != "twitter") & (F.col("fetch_error").isNotNull() | (F.col("http_status") >= 400)),
                    F.concat(F.lit("Error — "), T.substr_cap(F.coalesce(
                        "fetch_error", F.concat(F.lit("HTTP "), F.col("http_status").cast("string"))), 120)))
              .when((t == "twitter") & (F.col("_has_embed").isNull() | F.col("embed_error").isNotNull()),
                    F.concat(F.lit("Error — "), F.coalesce(F.col("embed_error"), F.lit(NO_POST_TEXT))))
              .when((t != "twitter") & (F.col("_has_page").isNull() | F.col("extract_error").isNotNull()),
                    F.concat(F.lit("Error — "), F.coalesce(F.col("extract_error"), F.lit(NO_CONTAINER))))
              .otherwise(F.lit("Processed")))
    reason = (F.when(F.col("_ov.err").isNotNull(), F.lit(None).cast("string"))
              .when(t == "blocked_social", F.lit(SKIP_SOCIAL_REASON))
              .when(t == "paywall", _fill(SKIP_PAYWALL_REASON, F.col("label")))
              .when((t != "twitter") & F.col("http_status").isin(401, 403), F.lit(SKIP_BLOCKED_REASON)))
    return j.select("row_ord", "url", "url_type", F.col("_ov.key").alias("override_key"),
                    status.alias("status"), reason.alias("skip_reason"), "notes", "page_title", "author_line")


def skip_notices(outcomes: DataFrame) -> DataFrame:
    """(url, reason) of skipped requests (nothing when none)."""
    return outcomes.where(F.col("skip_reason").isNotNull()).select("row_ord", "url", F.col("skip_reason").alias("reason"))
