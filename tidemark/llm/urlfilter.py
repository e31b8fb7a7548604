"""URL filtering by longest match in a trie of host labels and path segments (operator 6).

A rule is (host, path, verdict).  It fits a url whose host is the rule's host or a subdomain
of it and whose path starts with the rule's path.  The trie's first levels are host labels
from the right; each host node has the rules' paths by segment.  Among the fitting rules the
longest wins: the longer host, then the longer path; of the same rule given twice, block.
The trie is broadcast if the rule table has at most MAX_RULES rows and MAX_RULE_BYTES bytes,
which is counted first; a larger rule table is joined on the suffixes of each url's host.

Rows: a null url, or one without ://, has an empty host and path, fits no rule and is allowed;
repeated urls each give a row; rules with null host or path are ignored; an empty table gives
an empty table; columns other than the id and the url are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Fixed values of the query: (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Verdict where no rule fits.
DEFAULT = "allow"
MAX_RULES = 500_000
MAX_RULE_BYTES = 32 << 20
#: Fixed value: only these letters are lowered.
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path of a url."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    rest = rest.split("#", 1)[0].split("?", 1)[0]  # what the earlier of the two marks begins goes
    host, slash, path = rest.partition("/")
    return host.translate(LOWER), slash + path


class Node:
    """Of a label or a path segment: what follows, and the rules that end here."""

    __slots__ = ("next", "paths", "tails", "rule")

    def __init__(self) -> None:
        self.next: dict[str, Node] = {}
        self.paths: Node | None = None
        self.tails: dict[str, tuple[str, str]] = {}
        self.rule: tuple[str, str] | None = None


def build(rules: list[tuple[str, str, str]]) -> Node:
    """The trie of the rules."""
    root = Node()
    for host, path, verdict in rules:
        if host is None or path is None:
            continue
        node = root
        for label in reversed(host.translate(LOWER).split(".")):
            node = node.next.setdefault(label, Node())
        node.paths = node.paths or Node()
        at = node.paths
        *full, tail = path.split("/")
        for segment in full:
            at = at.next.setdefault(segment, Node())
        found = (host.translate(LOWER) + path, verdict)
        if tail not in at.tails or verdict == "block":
            at.tails[tail] = found
    return root


def best_path(node: Node, path: str) -> tuple[str, str] | None:
    """The rule with the longest path that ``path`` starts with."""
    found = None
    at: Node | None = node
    segments = path.split("/")
    for k, segment in enumerate(segments):
        fits = [t for t in at.tails if segment.startswith(t)] if len(at.tails) <= len(segment) else [t for n in range(len(segment) + 1) if (t := segment[:n]) in at.tails]
        if fits:
            found = at.tails[max(fits, key=len)]
        at = at.next.get(segment) if k + 1 < len(segments) else None
        if at is None:
            break
    return found


def longest(root: Node, host: str, path: str) -> tuple[str, str] | None:
    """The rule that wins for this host and path."""
    node, found = root, None
    for label in reversed(host.split(".")):
        node = node.next.get(label)
        if node is None:
            break
        if node.paths is not None and (hit := best_path(node.paths, path)):
            found = hit
    return found


def filter_urls(df: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row; ``rules`` has host, path, verdict."""
    narrow = df.select(df[id_col].cast("long").alias("page_id"), df[url_col].cast("string").alias("url"))
    rules = rules.select("host", "path", "verdict")
    size = rules.agg(F.count("*"), F.sum(F.octet_length("host") + F.octet_length("path"))).first()
    if size[0] > MAX_RULES or (size[1] or 0) > MAX_RULE_BYTES:
        return filter_by_join(narrow, rules, default)
    trie = df.sparkSession.sparkContext.broadcast([tuple(r) for r in rules.collect()])
    built: list[Node] = []

    def fn(part: pa.RecordBatch) -> dict:
        root = _trie(trie, built)
        urls = [split_url(u) for u in part.column(1).to_pylist()]
        hits = [longest(root, h, p) for h, p in urls]
        return {
            "page_id": part.column(0), "host": [h for h, _ in urls], "path": [p for _, p in urls],
            "rule": [h and h[0] for h in hits], "verdict": [h[1] if h else default for h in hits],
        }

    return common.map_slices(narrow, fn, "page_id long, host string, path string, rule string, verdict string")


def _trie(rules, built: list[Node]) -> Node:
    if not built:
        built.append(build(rules.value))
    return built[0]


def filter_by_join(narrow: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same for a rule table too large to broadcast: distinct (host, path) against rules by host suffix."""
    rest = F.when(F.instr("url", "://") > 0, F.regexp_extract("url", r"(?s)^.*?://([^?#]*)", 1)).otherwise("")
    lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    at = F.instr(rest, "/")
    host = F.translate(F.when(at > 0, F.substr(rest, F.lit(1), at - 1)).otherwise(rest), lower, lower.lower())
    pages = narrow.select("page_id", "url", host.alias("host"), F.when(at > 0, F.substr(rest, at)).otherwise("").alias("path"))
    keys = pages.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    r = rules.where("host is not null and path is not null").select(F.translate("host", lower, lower.lower()).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
    hits = keys.withColumn("r_host", F.explode(suffix)).join(r, "r_host").where(F.startswith("path", F.col("r_path")))
    order = F.struct(F.length("r_host"), F.length("r_path"), (F.col("r_verdict") == "block").cast("int"))
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict")), order).alias("best"))
    return pages.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return filter_urls(common.table(spark, sf_dir, "pages"), rules)


ORACLE = r"""
with u as (
  select page_id, case when strpos(url, '://') > 0 then regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') else '' end as rest from pages
), p as (
  select page_id,
    translate(case when strpos(rest, '/') > 0 then substr(rest, 1, strpos(rest, '/') - 1) else rest end, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    case when strpos(rest, '/') > 0 then substr(rest, strpos(rest, '/')) else '' end as path
  from u
), r(rule_host, rule_path, v) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
hit as (
  select p.page_id, p.host, p.path, rule_host || rule_path as rule, v,
    row_number() over (partition by p.page_id order by length(rule_host) desc nulls last, length(rule_path) desc) as k
  from p left join r on (p.host = rule_host or ends_with(p.host, '.' || rule_host)) and starts_with(p.path, rule_path)
)
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from hit where k = 1
"""
