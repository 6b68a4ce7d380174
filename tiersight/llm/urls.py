"""URL filtering: rules on host and path, and block decisions carried along redirects.

Pages that redirect to, or name as canonical, the same address are one page under several names.
Connected components over those links find the names; a blocked name blocks the others, unless one
of them is explicitly allowed.
"""

from __future__ import annotations

import html as html_module
import re
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tiersight.llm.flat import free_name, parts
from tiersight.llm.html_text import RAW, Tokens
from tiersight.operators.graph import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)"


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str  # with all its subdomains
    path: str  # what the path starts with

    @property
    def text(self) -> str:
        return self.host + self.path


def rule_of(verdict: str, text: str) -> Rule:
    """`example.com/en/` as a rule."""
    host, slash, path = text.partition("/")
    return Rule(verdict, host, slash + path)


def part(url: Column, group: int) -> Column:
    """Host (1), path (2) or query (3) of a url; empty without `://` or for null."""
    found = F.coalesce(F.regexp_extract(url, ADDRESS, group), F.lit(""))
    return F.translate(found, UPPER, LOWER) if group == 1 else found


def _fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def rule_columns(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, allow before block at equal length; else null."""
    text = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.verdict == "allow")):
        fits = _fits(rule, host, path)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def _by_join(rows: DataFrame, rules: DataFrame, text: str, verdict: str) -> DataFrame:
    """As `ruled`, for a table of rules: each name meets the rules of its host's suffixes by the starts of its path.

    Only suffixes of as many labels as rules have, and starts of as many letters as the rules of that host, are
    tried, each in an equal join. A host and path is judged once, however many rows have it.
    """
    tidy = rules.select("verdict", F.coalesce("host", F.lit("")).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"))
    # of rules alike in host and path the one that allows counts
    tidy = tidy.where("verdict is not null").groupBy("r_host", "r_path").agg(F.min("verdict").alias("verdict"))
    sizes = tidy.groupBy("r_host").agg(F.collect_set(F.length("r_path")).alias("sizes"))
    most = tidy.agg(F.max(F.size(F.split("r_host", r"\."))).alias("n")).first().n or 0
    key = free_name("_key", rows)
    # names without a host fit no rule that has one, and are dealt out
    nowhere = F.concat(F.lit("#"), F.monotonically_increasing_id() % 4096)
    keyed = rows.withColumn(key, F.when(F.col("host") != "", F.concat("host", "path")).otherwise(nowhere))
    once = rows.select("host", "path").where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(most, 1)))), lambda k: F.array_join(F.slice(labels, -k, k), "."))
    tried = once.select("host", "path", F.explode(tails).alias("r_host")).join(sizes, "r_host")
    tried = tried.select("host", "path", "r_host", F.explode(F.filter("sizes", lambda n: n <= F.length("path"))).alias("n")).select("host", "path", "r_host", F.substr(F.col("path"), F.lit(1), F.col("n")).alias("r_path"))
    found = tried.join(tidy, ["r_host", "r_path"])
    best = F.max(F.struct((F.length("r_host") + F.length("r_path")).alias("n"), (F.col("verdict") == "allow").alias("allows"), F.concat("r_host", "r_path").alias("text"), "verdict")).alias("x")
    judged = found.groupBy("host", "path").agg(best).select(F.concat("host", "path").alias(key), F.col("x.text").alias(text), F.col("x.verdict").alias(verdict))
    return keyed.join(judged, key, "left").drop(key)


def ruled(rows: DataFrame, rules: list[Rule] | DataFrame, text: str, verdict: str) -> DataFrame:
    """Rows (host, path, ...) with text and verdict of the longest rule that fits, allow before block at equal length; else null.

    A list of rules becomes one expression, without a shuffle; a table of them (verdict, host, path), of any size, is joined.
    """
    if isinstance(rules, DataFrame):
        return _by_join(rows, rules, text, verdict)
    t, v = rule_columns(rules, F.col("host"), F.col("path"))
    return rows.withColumns({text: t, verdict: v})


ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
REFRESH = re.compile(r"""^[\s\d.]*[;,]?\s*url\s*=\s*(?:"([^"]*)|'([^']*)|(.*))""", re.I | re.S)


def attributes(text: str) -> dict[str, str]:
    """A tag's attributes by name in lower case, the first of each name, character references decoded."""
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), html_module.unescape(a or b or c))
    return out


def links_of(page: str) -> tuple[str, list[str]]:
    """A page's base address, empty if it gives none, and the targets of its canonical links and meta refreshes, in order.

    Only tags count: not what looks like one in a comment, in a script or in another tag's quotes.
    """
    tokens, at, base, found = Tokens(page), 0, "", []
    while token := tokens.after(at):
        at = token.end
        if token.closing or not token.name:
            continue
        if token.name in RAW:
            close = re.compile(f"</{token.name}\\b", re.I).search(page, at)
            at = close.start() if close else len(page)
        elif token.name in ("link", "meta", "base"):
            own = attributes(token.attributes)
            target = own.get("href", "").strip()
            if token.name == "base":
                base = base or target
            elif token.name == "meta":
                m = REFRESH.search(own.get("content", "")) if own.get("http-equiv", "").strip().lower() == "refresh" else None
                target = ((m[1] or m[2] or m[3] or "") if m else "").strip()
            elif "canonical" not in own.get("rel", "").lower().split():
                continue
            if target and token.name != "base":
                found.append(target)
    return base, found


def page_links(pages: DataFrame) -> DataFrame:
    """(url, base, target) of all canonical links and meta refreshes in the pages' html, and the base address that they are relative to, if any."""
    own = pages.where(F.col("url").contains("://") & F.col("html").rlike("(?i)canonical|refresh")).select("url", "html")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in parts(batch, "html"):
                rows = [(url, base, target) for url, page in zip(piece.column("url").to_pylist(), piece.column("html").to_pylist()) for base, targets in [links_of(page)] for target in targets]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], ["url", "base", "target"])

    return own.mapInArrow(each, "url string, base string, target string")


@F.pandas_udf(StringType())
def resolved(url: pd.Series, base: pd.Series, target: pd.Series) -> pd.Series:
    """A link's target as an absolute address, dot segments taken out; null where there is none."""

    def one(url: str | None, base: str | None, target: str | None) -> str | None:
        if not url or not target or "://" not in url:
            return None
        try:  # the scheme tells nothing here, and joining knows only some
            return urljoin(urljoin("http" + url[url.index("://") :], base or ""), target)
        except ValueError:
            return None

    return pd.Series([one(*x) for x in zip(url, base, target)], dtype=object)


def node(url: Column) -> Column:
    """What names a page in links: host, path and query, without scheme and fragment."""
    return F.when(url.contains("://"), F.concat(part(url, 1), part(url, 2), part(url, 3)))


def url_verdicts(pages: DataFrame, rules: list[Rule] | DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """All columns of `pages`, and host, path, rule, verdict and via.

    rules: a list, or a table (verdict, host, path) for block lists of any size. redirects: more links
    (url, target) from a crawl's log. via says what decided: rule, alias or
    none. A url that no rule fits gets block if a name reachable over links is blocked and none is
    allowed; otherwise allow. Null urls and urls without `://` have empty host and path, fit no rule
    and are allowed. Repeated rows are judged alike. A column of `pages` named like a new one is
    replaced.
    """
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select("url", F.lit("").alias("base"), "target"))
    edges = links.select(node(F.col("url")).alias("a"), node(resolved(F.col("url"), F.col("base"), F.col("target"))).alias("b"))
    names = components(edges)
    full = F.concat(F.lit("x://"), F.col("node"))
    judged = ruled(names.select("node", "component", part(full, 1).alias("host"), part(full, 2).alias("path")), rules, "rule", "own").select("node", "component", "own")
    groups = judged.groupBy("component").agg(
        F.when(F.bool_or(F.col("own") == "allow"), "allow").when(F.bool_or(F.col("own") == "block"), "block").alias("alias_verdict")
    )
    name, own, other = (free_name(x, pages) for x in ("_node", "_own", "_alias"))
    alias = judged.join(groups, "component").where("alias_verdict is not null").select(F.col("node").alias(name), F.col("alias_verdict").alias(other))
    taken = [f"`{c}`" for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict", "via")]
    host, path = part(F.col("url"), 1), part(F.col("url"), 2)
    # names never hold a #, so rows without one are dealt out and meet nothing
    nowhere = F.concat(F.lit("#"), F.monotonically_increasing_id() % 4096)
    rows = pages.select(*taken, host.alias("host"), path.alias("path"), F.coalesce(node(F.col("url")), nowhere).alias(name))
    out = ruled(rows, rules, "rule", own).join(alias, name, "left")
    via = F.when(F.col(own).isNotNull(), "rule").when(F.col(other).isNotNull(), "alias").otherwise("none")
    return out.select(*taken, "host", "path", "rule", F.coalesce(own, other, F.lit("allow")).alias("verdict"), via.alias("via"))
