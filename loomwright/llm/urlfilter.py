"""URL rules whose block decisions spread to aliases over redirect and canonical-link edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import cut, group_values, salted
from loomwright.llm.components import connected_components


@dataclass(frozen=True)
class Rule:
    """A rule fits its host and all subdomains, on paths that start with its path."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased."""
    host = F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        name = F.when(fits, F.lit(rule.name)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


_ATTR = r"""\s*=\s*["']?([^"'\s>]*)"""
_LINK = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
_META = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def plain(url: Column) -> Column:
    """A url without fragment, its scheme and host in lower case, an empty path as /; null without ://."""
    scheme = F.regexp_extract(url, r"^(.*?)://", 1)
    rest = F.regexp_extract(after_scheme(url), r"^[^/?#]*([^#]*)", 1)
    path = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(F.instr(url, "://") > 0, F.concat(F.lower(scheme), F.lit("://"), host_of(url), path))


def resolved(target: Column, base: Column) -> Column:
    """The url that a link's target names on the page `base` (both strings), without dot segments."""
    origin = F.regexp_extract(base, r"^([^:/?#]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[^:/?#]*://[^/?#]*([^?#]*)", 1)
    folder = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(path, "^/", ""), r"[^/]*$", ""))
    whole = (
        F.when(target.rlike(_SCHEME), target)
        .when(target.startswith("//"), F.concat(F.regexp_extract(base, r"^([^:/?#]*:)", 1), target))
        .when(target.startswith("/"), F.concat(origin, target))
        .when(target.startswith("?"), F.concat(origin, path, target))
        .when(target.startswith("#"), base)
        .otherwise(F.concat(origin, folder, target))
    )
    start, way, more = (F.regexp_extract(whole, r"^([^:/?#]*://[^/?#]*)([^?#]*)(.*)$", n) for n in (1, 2, 3))
    parts = F.split(way, "/", -1)
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))),
    )
    kept = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(way.rlike(r"(^|/)\.\.?(/|$)"), F.concat(start, F.array_join(kept, "/"), more)).otherwise(whole)


def alias_links(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """Rows (a, b): a page's url and the url that one of its canonical links or refresh redirects names, both plain()."""
    html = F.col(html_col).cast("string")
    links = F.transform(F.regexp_extract_all(html, F.lit(_LINK), F.lit(0)), lambda x: F.regexp_extract(x, r"(?is)\bhref" + _ATTR, 1))
    metas = F.transform(F.regexp_extract_all(html, F.lit(_META), F.lit(0)), lambda x: F.regexp_extract(x, r"""(?is)\burl\s*=\s*["']?([^"'\s>;]*)""", 1))
    rows = pages.select(F.col(url_col).cast("string").alias("_page"), F.explode(F.concat(links, metas)).alias("_t")).where("_t <> ''")
    target = F.regexp_replace("_t", "&(amp|#38|#x26);", "&")
    rows = rows.select(plain(F.col("_page")).alias("a"), plain(resolved(target, F.col("_page"))).alias("b"))
    return rows.where("a is not null and b is not null")


def judge(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: tuple[Rule, ...] = RULES, links: DataFrame | None = None
) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict), one for each row of pages.

    A url has its own rule's verdict. Without one it is blocked if a url of its alias class (the
    connected component over the links, pages or not) is blocked by rule, unless one of
    the class is allowed by rule: an explicit allow goes before a block that comes by
    alias. All others are allowed. links (a, b) are added to those found in the pages. Urls are one node
    whatever the case of their scheme and host, and whatever their fragment; targets are resolved
    against the page's url.

    Defined cases: a url that is null or has no :// has an empty host and path, no rule
    and no aliases; null html has no links; of several links in a page all count, in pages of any length; repeated rows
    are judged alike; an empty table gives no rows; further columns are not read.
    """
    edges = alias_links(pages, url_col, html_col)
    if links is not None:
        edges = edges.unionByName(links.select(plain(F.col("a")).alias("a"), plain(F.col("b")).alias("b")).where("a is not null and b is not null"))
    classes = salted(connected_components(edges), "node")
    own = rule_for(host_of(F.col("node")), path_of(F.col("node")), rules)[1]
    marked = classes.withColumn("blocks", (F.coalesce(own, F.lit("")) == "block").cast("int")).withColumn("allows", (F.coalesce(own, F.lit("")) == "allow").cast("int"))
    totals = group_values(
        marked, ["component"], {"b": F.max("blocks"), "w": F.max("allows")}, {"b": F.max("b"), "w": F.max("w")}
    )
    blocked = marked.join(totals.where("b = 1 and w = 0"), ["component", "_salt"]).select(F.col("node").alias("_url")).distinct()
    blocked = cut(blocked, "blocked")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("_url"))
    rows = rows.withColumn("host", F.coalesce(host_of(F.col("_url")), F.lit(""))).withColumn("path", F.coalesce(path_of(F.col("_url")), F.lit("")))
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", name).withColumn("_own", verdict).withColumn("_url", plain(F.col("_url")))
    rows = salted(rows, "page_id", "_url", salts=16)
    # a url of many pages is met by its alias row once for each salt
    alias = blocked.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(15)))).withColumn("_alias", F.lit("block"))
    rows = rows.join(alias, ["_url", "_salt"], "left")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("_own", "_alias", F.lit("allow")).alias("verdict"))
