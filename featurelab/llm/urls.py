"""URL filters that also hold for aliases: redirects and canonical links.

Pages that redirect to each other, or name the same canonical page, are one component of the link
graph. A rule decides for the pages it fits; a block is passed on to every alias of such a page
that no rule fits. An explicit allow takes precedence: the page it fits stays allowed whatever its
aliases are, and the longest rule that fits a page is the one that counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurelab.llm.components import connected_components
from featurelab.sources.work import materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains, where the path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    def __str__(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.when(at > 0, F.translate(host, _UPPER, _LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else NULL. ``rules`` is a parameter and part of
    the plan; of two equally long ones the longer host wins."""
    ordered = sorted(rules, key=lambda r: (-len(str(r)), -len(r.host), str(r), r.verdict))
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    return F.coalesce(
        none,
        *[
            F.when(
                ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
                F.struct(F.lit(str(r)).alias("rule"), F.lit(r.verdict).alias("verdict")),
            )
            for r in ordered
        ],
    )


def alias_key(url: Column) -> Column:
    """Digest that is equal for the same page: host, path and query, without scheme and fragment."""
    at = F.instr(url, "://")
    rest = F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*([^#]*)", 1)
    return F.when(at > 0, F.unhex(F.md5(F.concat(host_of(url), F.lit("\n"), rest))))


def resolved(base: Column, link: Column) -> Column:
    """The absolute URL of a link on the page ``base``; NULL for an empty link."""
    link = F.trim(F.replace(link, F.lit("&amp;"), F.lit("&")))
    scheme = F.regexp_extract(base, r"^([^:/?#]*)://", 1)
    origin = F.regexp_extract(base, r"^[^:/?#]*://[^/?#]*", 0)
    folder = F.regexp_extract(base, r"^[^:/?#]*://[^/?#]*([^?#]*/)?", 1)
    return (
        F.when(link == "", None)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link.startswith("#"), base)
        .when(link.startswith("?"), F.concat(F.regexp_extract(base, r"^[^?#]*", 0), link))
        .otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), link))
    )


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst): absolute URLs of each page and its canonical link or refresh target."""
    tags = F.regexp_extract_all(F.col(html_col), F.lit(r"(?i)<(?:link|meta)\s[^<>]*>"), F.lit(0))
    told = F.filter(
        tags,
        lambda t: t.rlike(r"""(?is)^<link\s(.*\s)?rel\s*=\s*["']?([^"'<>]*\s)?canonical["'\s/>]""")
        | t.rlike(r"""(?is)^<meta\s(.*\s)?http-equiv\s*=\s*["']?refresh["'\s/>]"""),
    )

    def target(tag: Column) -> Column:
        of_link = F.regexp_extract(tag, r"""(?is)\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", 0)
        of_meta = F.regexp_extract(tag, r"""(?is)\scontent\s*=\s*["']?[^"'>]*?\burl\s*=\s*["']?([^"'>]*)""", 1)
        plain = F.regexp_replace(of_link, r"""(?is)^\shref\s*=\s*["']?|["']$""", "")
        return F.when(tag.rlike("(?i)^<link"), plain).otherwise(of_meta)

    rows = pages.select(F.col(url_col).alias("src"), F.explode(F.transform(told, target)).alias("link"))
    return rows.select("src", resolved(F.col("src"), F.col("link")).alias("dst")).where("src is not null and dst is not null")


def judge_urls(
    pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url",
    html_col: str = "html", default: str = "allow",
) -> DataFrame:
    """(id_col, host, path, rule, verdict), one row per page.

    Links come from the pages' canonical links and refresh tags, and from ``redirects`` (two columns:
    from and to URL). ``rule`` is NULL where no rule fits; then the verdict is ``block`` if an alias is
    blocked by a rule, else ``default``. A rule can also block an alias through a URL that is only a
    link's target.

    A NULL url, or one without ``://``, has an empty host and path and no aliases. A NULL html has no
    links. Repeated rows stay repeated. Other columns are not read. An empty table gives an empty one.
    """
    bad = {r.verdict for r in rules} - {"allow", "block"}
    if bad:
        raise ValueError(f"unknown verdicts: {sorted(bad)}")
    links = page_links(pages, url_col, html_col)
    if redirects is not None:
        src, dst = redirects.columns
        links = links.unionByName(redirects.select(F.col(src).alias("src"), F.col(dst).alias("dst")))
    ends = F.array(
        F.struct(alias_key(F.col("src")).alias("key"), F.col("src").alias("url")),
        F.struct(alias_key(F.col("dst")).alias("key"), F.col("dst").alias("url")),
    )
    links = materialize(links.select(ends.alias("ends")), "links")
    linked = connected_components(links.select(F.col("ends")[0]["key"].alias("a"), F.col("ends")[1]["key"].alias("b")))
    # Every node lies in ``ends``: rules are tried on targets as on pages.
    urls = links.select(F.explode("ends").alias("end")).select("end.key", "end.url").where("key is not null")
    own = longest_rule(host_of(F.col("url")), path_of(F.col("url")), rules)
    blocked = urls.where(F.coalesce(own["verdict"], F.lit("")) == "block").select(F.col("key").alias("node")).distinct()
    roots = linked.join(blocked, "node", "left_semi").select("root").distinct()
    tainted = materialize(linked.join(roots, "root", "left_semi").select(F.col("node").alias("key")), "tainted")
    told = pages.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url")
    ).select("id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    told = told.withColumn("own", longest_rule(F.col("host"), F.col("path"), rules)).withColumn("key", alias_key(F.col("url")))
    judged = told.join(tainted.withColumn("tainted", F.lit(True)), "key", "left")
    verdict = F.coalesce(F.col("own")["verdict"], F.when(F.col("tainted"), "block"), F.lit(default))
    return judged.select(
        F.col("id").alias(id_col), "host", "path", F.col("own")["rule"].alias("rule"), verdict.alias("verdict")
    )
