"""URL filters: longest-rule verdicts, and redirect equivalence for the URLs that no rule fits.

Pages that redirect to each other or name a canonical link are aliases: every ``<link rel=canonical>`` and refresh
``<meta>`` of a page counts, and a redirect log, if there is one. Links are resolved on their page's URL (absolute,
scheme-relative, rooted and relative ones, dot segments, a ``?query`` alone); links of other schemes are none. URLs meet in
their plain spelling: scheme and host in lower case, an empty path as ``/``, no fragment. Aliases form connected components;
a block decision on one member reaches the members that no rule fits, unless a member is explicitly allowed. Everything is
a DataFrame operation.

Rules are a short list on the driver, so they are looked up in a literal map by the suffixes of a row's host, without a
join. Rows then meet the components by their URL; rows without one are spread by hashes of their page_id.

Defined results: a null URL, or one without ``://``, has empty host and path and no rule, and is allowed.
Repeated rows keep their own result row; of equal rules the allowing one counts. Extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweepline.llm.components import connected_components

#: Fixed values: (host, path, verdict) of the production rules.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://``, its A-Z lower-cased; then the path up to a query or fragment."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def plain_spelling(url: Column) -> Column:
    """One spelling of a URL: its node among the aliases; null where there is no ``://``."""
    scheme = F.regexp_extract(url, r"^([^:/?#]+)://", 1)
    rest = F.regexp_extract(url, r"(?s)^[^:/?#]+://(.*)$", 1)
    host, path = F.regexp_extract(rest, r"^[^/?#]*", 0), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)", 1)
    spelled = F.concat(F.lower(scheme), F.lit("://"), lower_ascii(host), F.when(path == "", "/").otherwise(path), query)
    return F.when(scheme != "", spelled)


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct<rule, verdict> of the longest rule that fits, or null.

    Looked up are only suffixes with as many labels as some rule's host. Of equally long rules the longer host, then
    the allowing one, counts.
    """
    if not rules:
        return F.lit(None).cast("struct<rule: string, verdict: string>")
    by_host: dict[str, list[tuple[str, str]]] = {}
    for h, p, v in rules:
        by_host.setdefault(h, []).append((p, v))
    entry = lambda h, p, v: F.struct(
        F.lit(len(h + p)).alias("n"), F.lit(len(h)).alias("h"), F.lit(v == "allow").alias("a"), F.lit(h + p).alias("rule"),
        F.lit(v).alias("verdict"), F.lit(p).alias("path"),
    )
    table = F.create_map(*[x for h, of in sorted(by_host.items()) for x in (F.lit(h), F.array(*[entry(h, p, v) for p, v in sorted(of)]))])
    parts = F.split(host, r"\.")
    suffixes = F.array_compact(
        F.array(*[F.when(F.size(parts) >= n, F.array_join(F.slice(parts, -n, n), ".")) for n in sorted({h.count(".") + 1 for h in by_host})])
    )
    found = F.flatten(F.array_compact(F.transform(suffixes, lambda s: F.try_element_at(table, s))))
    best = F.array_max(F.filter(found, lambda r: path.startswith(r["path"])))
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def without_dots(path: Column) -> Column:
    """A rooted path without ``.`` and ``..`` segments."""
    parts = F.split(F.substr(path, F.lit(2)), "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda out, x: F.when(x == ".", out)
        .when(x == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))))
        .otherwise(F.concat(out, F.array(x))),
    )
    ended = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.concat(F.lit("/"), F.array_join(ended, "/"))


def resolved(target: Column, page: Column) -> Column:
    """A link's target as a whole URL; null where it has another scheme or the page has no ``://``."""
    origin = F.regexp_extract(page, r"^([^:/?#]+://[^/?#]*)", 1)
    scheme = F.regexp_extract(page, r"^([^:/?#]+:)//", 1)
    path = F.regexp_extract(page, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    link, tail = F.regexp_extract(target, r"^[^?#]*", 0), F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.concat(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), F.lit("/"))
    whole = (
        F.when(link == "", F.concat(origin, path, tail))
        .when(link.startswith("/"), F.concat(origin, without_dots(link), tail))
        .otherwise(F.concat(origin, without_dots(F.concat(folder, link)), tail))
    )
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (origin == ""), F.lit(None))
        .when(target.startswith("//"), F.concat(scheme, target))
        .otherwise(whole)
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """(url, target) of all canonical links and refresh redirects, targets resolved on their pages."""
    html = F.coalesce("html", F.lit(""))
    every = lambda pattern: F.regexp_extract_all(html, F.lit(pattern), 0)
    canonical = F.filter(every(r"(?is)<link\b[^>]*>"), lambda x: x.rlike(r"""(?is)\brel\s*=\s*("[^"]*\bcanonical\b|'[^']*\bcanonical\b|canonical\b)"""))
    refresh = F.filter(every(r"(?is)<meta\b[^>]*>"), lambda x: x.rlike(r"""(?is)\bhttp-equiv\s*=\s*["']?refresh\b"""))
    targets = F.concat(
        F.transform(canonical, lambda x: F.regexp_extract(x, r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)""", 1)),
        F.transform(refresh, lambda x: F.regexp_extract(x, r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)""", 1)),
    )
    found = (
        pages.where(F.col("url").isNotNull())
        .where(F.lower(html).contains("canonical") | F.lower(html).contains("http-equiv"))
        .select("url", F.explode(targets).alias("target"))
        .where("target <> ''")
    )
    return found.select("url", resolved(F.replace("target", F.lit("&amp;"), F.lit("&")), F.col("url")).alias("target")).where("target is not null")


def filter_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, edges: DataFrame | None = None
) -> DataFrame:
    """page_id, url, host, path, rule, component, verdict of every row of pages (page_id, url, html).

    component is the smallest alias, null for URLs without aliases. edges adds (url, target) links from elsewhere, such as a
    crawler's redirect log.
    """
    links = alias_edges(pages)
    if edges is not None:
        links = links.unionByName(edges.toDF("url", "target"))
    plain = links.select(plain_spelling(F.col("url")).alias("url"), plain_spelling(F.col("target")).alias("target"))
    component = connected_components(plain)  # a written table
    node_rule = best_rule(*host_and_path(F.col("node")), rules)
    # allow sorts before block
    decided = component.select("component", node_rule["verdict"].alias("verdict")).groupBy("component").agg(F.min("verdict").alias("spread"))
    spread = component.join(decided, "component")
    host, path = host_and_path(F.col("url"))
    judged = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    alone = F.concat(F.lit("\x00"), F.pmod(F.xxhash64("page_id"), F.lit(1 << 16)).cast("string"))
    return (
        judged.withColumn("node", F.coalesce(plain_spelling(F.col("url")), alone))
        .join(spread, "node", "left")
        .select(
            "page_id", "url", "host", "path", F.col("best.rule").alias("rule"), "component",
            F.coalesce("best.verdict", "spread", F.lit("allow")).alias("verdict"),
        )
    )
