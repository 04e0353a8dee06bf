"""URL filters: rules, and trust and distrust propagated over links between hosts.

A rule is a host and the start of a path; it fits the host and its subdomains, and the
longest fitting rule decides. Pages that no rule fits are judged by their host. Hosts of
which rules allow more than half of the pages are trusted seeds, hosts of which they block
more than half are blocked seeds. Trust flows from seeds along links (personalised
PageRank), distrust flows from seeds against them, to who links there; a host shares what
it has by the number of pages with the link. What a host without links would pass on is
lost. A host is blocked if distrust is above `threshold` of its trust and distrust
together; without either it is allowed.

Links are the hosts of absolute and scheme-relative `href` and `src` attributes; relative
ones stay on the host and carry nothing. Edges are counted with a map-side aggregate per
pair of hosts, and each round joins them with one score row per host, so a hub's edges
may be split. Rounds are written to the shared folder and end when no score moves by more
than `tolerance`.

A null url or one without `://` has an empty host and path, fits no rule and is allowed.
Null html has no links. Repeated pages count each. Tables without links or seeds need no
round.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from termwarden.llm.common import ascii_lower, work_folder
from termwarden.sources.scratch import WorkFolder

LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:https?:)?//(?:[^/?#"'\s>@]*@)?([^/?#"'\s>@]+)"""
DAMPING, TOLERANCE, THRESHOLD = 0.85, 1e-4, 0.5


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    def __str__(self) -> str:
        return self.host + self.path


#: The rules asked for.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-case host after the first `://`, and the path up to a query or fragment."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def judged_by_rules(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits."""
    found = verdict = None
    for rule in sorted(rules, key=lambda r: -len(str(r))):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        found = F.when(fits, str(rule)) if found is None else found.when(fits, str(rule))
        verdict = F.when(fits, rule.verdict) if verdict is None else verdict.when(fits, rule.verdict)
    none = F.lit(None).cast("string")
    return (none, none) if found is None else (found, verdict)


def propagated(
    hosts: DataFrame, links: DataFrame, work: WorkFolder, damping: float, tolerance: float
) -> DataFrame:
    """`(host, trust, distrust)`.

    `hosts` has `host` and the seeds `trusted` and `blocked`, 0 or 1; `links` has `source`,
    `target` and the number of pages `n`, once per pair.
    """
    links = work.write("links", links)
    out = links.groupBy(F.col("source").alias("_s")).agg(F.sum("n").alias("_out"))
    into = links.groupBy(F.col("target").alias("_t")).agg(F.sum("n").alias("_in"))
    out, into = work.write("out", out), work.write("into", into)
    shared = links.join(out, links.source == out["_s"]).join(into, links.target == into["_t"])
    none = F.lit(0.0)
    flows = shared.select(
        F.col("source").alias("from"), F.col("target").alias("to"),
        (F.col("n") / F.col("_out")).alias("trust_share"), none.alias("distrust_share"),
    ).unionAll(
        shared.select(
            F.col("target").alias("from"), F.col("source").alias("to"),
            none.alias("trust_share"), (F.col("n") / F.col("_in")).alias("distrust_share"),
        )
    )
    flows = work.write("flows", flows)
    nodes = hosts.select("host", "trusted", "blocked").unionByName(
        links.select(F.explode(F.array("source", "target")).alias("host"))
        .distinct()
        .join(hosts, "host", "left_anti")
        .select("host", F.lit(0).alias("trusted"), F.lit(0).alias("blocked"))
    )
    keep = 1 - damping
    scores = work.write(
        "scores-0",
        nodes.select(
            "host", "trusted", "blocked",
            (F.col("trusted") * keep).alias("trust"), (F.col("blocked") * keep).alias("distrust"),
        ),
    )
    if flows.isEmpty() or scores.where("trusted + blocked > 0").isEmpty():
        return scores.select("host", "trust", "distrust")
    turn, moved = 0, True
    while moved:
        turn += 1
        seen = Observation()
        arriving = (
            flows.join(scores.select(F.col("host").alias("from"), "trust", "distrust"), "from")
            .groupBy(F.col("to").alias("host"))
            .agg(
                F.sum(F.col("trust") * F.col("trust_share")).alias("_trust"),
                F.sum(F.col("distrust") * F.col("distrust_share")).alias("_distrust"),
            )
        )
        new = lambda seed, got: F.round(F.col(seed) * keep + damping * F.coalesce(got, none), 12)
        scores_next = scores.join(arriving, "host", "left").select(
            "host", "trusted", "blocked",
            new("trusted", F.col("_trust")).alias("trust"),
            new("blocked", F.col("_distrust")).alias("distrust"),
            F.greatest(
                F.abs(new("trusted", F.col("_trust")) - F.col("trust")),
                F.abs(new("blocked", F.col("_distrust")) - F.col("distrust")),
            ).alias("_moved"),
        )
        stored = work.write(f"scores-{turn}", scores_next.observe(seen, F.max("_moved").alias("most")))
        moved = (seen.get["most"] or 0) > tolerance
        scores = stored.drop("_moved")
    return scores.select("host", "trust", "distrust")


def judged(
    pages: DataFrame,
    rules: Sequence[Rule] = RULES,
    damping: float = DAMPING,
    tolerance: float = TOLERANCE,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """`(page_id, host, path, rule, verdict, trust, distrust)` of every page."""
    work = work_folder(pages)
    host, path = host_and_path(F.col("url"))
    linked = F.array_distinct(
        F.transform(
            F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)), ascii_lower
        )
    )
    seen = pages.select("page_id", host.alias("host"), path.alias("path"), linked.alias("_linked"))
    rule, verdict = judged_by_rules(F.col("host"), F.col("path"), rules)
    seen = work.write("pages", seen.select("*", rule.alias("rule"), verdict.alias("_verdict")))
    hosts = (
        seen.where("host != ''")
        .groupBy("host")
        .agg(
            (F.count_if(F.col("_verdict") == "allow") * 2 > F.count(F.lit(1))).cast("int").alias("trusted"),
            (F.count_if(F.col("_verdict") == "block") * 2 > F.count(F.lit(1))).cast("int").alias("blocked"),
        )
    )
    links = (
        seen.where((F.size("_linked") > 0) & (F.col("host") != ""))
        .select(F.col("host").alias("source"), F.explode("_linked").alias("target"))
        .where("source != target")
        .groupBy("source", "target")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    scores = propagated(work.write("hosts", hosts), links, work, damping, tolerance)
    distrusted = F.col("distrust") > threshold * (F.col("trust") + F.col("distrust"))
    return seen.join(scores, "host", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("_verdict", F.when(distrusted, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
