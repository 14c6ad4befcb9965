"""URL filters by propagation over the link graph of hosts, with DataFrame functions only.

Trust is a personalised PageRank that starts from the hosts of allowed pages and follows links; distrust starts from the
hosts of blocked pages and follows links backwards. A host is blocked when its distrust exceeds its trust.

The host of a url is what stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; the
path follows up to ``?``, ``#`` or the end. Null urls and urls without ``://`` have an empty host and path, fit no rule
and are judged as the empty host, which has no links. Links are the ``href`` and ``src`` values with ``//``; their host is
read by the rule of the urls, port and user part included, so both ends of an edge carry one name. Other text, mail
addresses among it, is no link. Null html has no links; very long html is read whole. Repeated rows count and are judged each
on its own. Of rules of one length that fit a url, the first in alphabetical order wins. An empty table gives an empty
result; further columns of any name are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.joins import spread_join
from ..plans.materialize import drop_table, materialize

#: Rounds of the oracle; what they leave out is below ``DAMPING ** ROUNDS`` = 1e-14.
ROUNDS = 200
DAMPING = 0.85
#: The ranks are settled when a round changes both vectors by less than this in sum and reaches no further host.
TOLERANCE = 1e-12
#: Rounds after which ranks that are not settled are an error.
MAX_ROUNDS = 1000
#: Edges of one host that a task joins; more are cut into parts.
EDGES_PER_TASK = 4000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The host in a ``href`` or ``src`` value.
LINK = r"""(?:[hH][rR][eE][fF]|[sS][rR][cC])[ \t\n\f\r]*=[ \t\n\f\r]*["']?[ \t\n\f\r]*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#"'<> \t\n\f\r]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, else null. A rule is ``host/path``; it fits the host and its subdomains."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), [-ord(c) for c in r])):  # the last that fits wins
        at, _, below = rule.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit("/" + below))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def ruled(pages: DataFrame, rules: dict[str, str]) -> DataFrame:
    """``page_id, host, path, rule`` and ``decision``, the verdict of the rule or null."""
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parts = parts.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    decision = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        decision = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(decision)
    return parts.withColumn("decision", decision)


def host_edges(pages: DataFrame) -> DataFrame:
    """``src, dst, n``: links between different hosts, summed before the shuffle."""
    named = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("dst"))
    named = named.withColumn("dst", F.translate("dst", _UPPER, _LOWER)).filter("src != '' and dst != src")
    return named.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, rounds: int | None = None, damping: float = DAMPING,
              tolerance: float = TOLERANCE, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """``host, trust, distrust`` from ``seeds(host, allowed, blocked)``: settled, or after ``rounds`` steps.

    Both start vectors sum to one. Each end of an edge carries a part number of its host, so the edges of a host with
    many links are joined by several tasks. One shuffle per round adds up both directions; each round is written, and the
    table of the round before is deleted. Without ``rounds``, a sum over the written table tells whether the ranks are
    settled; what is missing then is less than ``tolerance * damping / (1 - damping)`` in sum.
    """
    edges = materialize(edges)
    out = edges.groupBy(F.col("src").alias("host")).agg(F.sum("n").alias("n_out"), F.count(F.lit(1)).alias("e_out"))
    into = edges.groupBy(F.col("dst").alias("host")).agg(F.sum("n").alias("n_in"), F.count(F.lit(1)).alias("e_in"))
    total = seeds.agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b")).first()
    parts = lambda c: F.greatest(F.ceil(F.coalesce(c, F.lit(0)) / EDGES_PER_TASK), F.lit(1)).cast("int")
    hosts = seeds.join(out, "host", "full").join(into, "host", "full").select(
        "host", (F.coalesce("allowed", F.lit(0)) / float(total["a"] or 1)).alias("s_trust"),
        (F.coalesce("blocked", F.lit(0)) / float(total["b"] or 1)).alias("s_distrust"),
        "n_out", "n_in", parts(F.col("e_out")).alias("p_out"), parts(F.col("e_in")).alias("p_in"),
    )
    hosts = materialize(hosts)
    cut = hosts.filter("p_out > 1 or p_in > 1")
    placed = spread_join(edges, cut.select(F.col("host").alias("src"), "p_out"), ["src"], "dst", "left")
    placed = spread_join(placed, cut.select(F.col("host").alias("dst"), "p_in"), ["dst"], "src", "left")
    placed = materialize(placed.select(
        "src", "dst", "n", F.pmod(F.hash("dst"), F.coalesce("p_out", F.lit(1))).alias("out_part"),
        F.pmod(F.hash("src"), F.coalesce("p_in", F.lit(1))).alias("in_part"),
    ))
    now = hosts.withColumns({"trust": F.col("s_trust"), "distrust": F.col("s_distrust")})
    before = None
    for _ in range(max_rounds if rounds is None else rounds):
        sends = now.filter("n_out is not null").select(
            F.col("host").alias("src"), (F.col("trust") / F.col("n_out")).alias("x"),
            F.explode(F.sequence(F.lit(0), F.col("p_out") - 1)).alias("out_part"),
        )
        backs = now.filter("n_in is not null").select(
            F.col("host").alias("dst"), (F.col("distrust") / F.col("n_in")).alias("x"),
            F.explode(F.sequence(F.lit(0), F.col("p_in") - 1)).alias("in_part"),
        )
        zero = F.lit(0.0)
        forth = placed.join(sends, ["src", "out_part"]).select(F.col("dst").alias("host"), (F.col("x") * F.col("n")).alias("t"), zero.alias("d"))
        back = placed.join(backs, ["dst", "in_part"]).select(F.col("src").alias("host"), zero.alias("t"), (F.col("x") * F.col("n")).alias("d"))
        got = forth.unionByName(back).groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        step = now.join(got, "host", "left")
        step = step.select(
            *hosts.columns, F.col("trust").alias("_t"), F.col("distrust").alias("_d"),
            (F.col("s_trust") * (1 - damping) + F.coalesce("t", zero) * damping).alias("trust"),
            (F.col("s_distrust") * (1 - damping) + F.coalesce("d", zero) * damping).alias("distrust"),
        )
        now = materialize(step.select(
            *hosts.columns, "trust", "distrust", (F.abs(F.col("trust") - F.col("_t")) + F.abs(F.col("distrust") - F.col("_d"))).alias("moved"),
            (((F.col("trust") > 0) & (F.col("_t") == 0)) | ((F.col("distrust") > 0) & (F.col("_d") == 0))).alias("reached"),
        ))
        if before is not None:
            drop_table(before)
        before = now
        if rounds is None:
            moved, reached = now.agg(F.sum("moved"), F.count_if("reached")).first()
            if not reached and (moved or 0) < tolerance:
                break
    else:
        if rounds is None:
            raise RuntimeError(f"ranks did not settle in {max_rounds} rounds")
    return now.select("host", "trust", "distrust")


def judge(pages: DataFrame, rules: dict[str, str], rounds: int | None = None, damping: float = DAMPING) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` for every page."""
    split = ruled(pages, rules)
    seeds = split.groupBy("host").agg(
        F.count_if(F.col("decision") == "allow").alias("allowed"), F.count_if(F.col("decision") == "block").alias("blocked")
    )
    scores = propagate(seeds, host_edges(pages), rounds, damping)
    scored = spread_join(split, scores, ["host"], F.xxhash64("page_id", "path"), "left")
    own = F.when(F.col("distrust") > F.col("trust"), "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("decision", own).alias("verdict"), "trust", "distrust")


def oracle(rules: dict[str, str], rounds: int = ROUNDS, damping: float = DAMPING) -> str:
    """SQL for ``judge`` without the scores."""
    order = sorted(rules, key=lambda r: (-len(r), r))
    fits = " ".join(
        f"WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) "
        f"AND starts_with(path, '/{r.partition('/')[2]}') THEN '{r}'" for r in order
    )
    verdicts = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in rules.items())
    link = LINK.replace("'", "''")
    return rf"""
WITH RECURSIVE parts AS (
  SELECT page_id, html, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), ruled AS MATERIALIZED (
  SELECT page_id, host, path, CASE {fits} END AS rule FROM parts
), decided AS MATERIALIZED (
  SELECT *, CASE rule {verdicts} END AS decision FROM ruled
), links AS (
  SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{_UPPER}', '{_LOWER}') AS dst FROM parts
), e0 AS (
  SELECT src, dst, count(*) AS n FROM links WHERE src <> '' AND dst <> src GROUP BY 1, 2
), e AS MATERIALIZED (
  SELECT *, sum(n) OVER (PARTITION BY src) AS n_out, sum(n) OVER (PARTITION BY dst) AS n_in FROM e0
), seeds AS (
  SELECT host, count(*) FILTER (WHERE decision = 'allow') AS a, count(*) FILTER (WHERE decision = 'block') AS b
  FROM decided GROUP BY 1
), hosts AS MATERIALIZED (
  SELECT host, coalesce(a, 0) / (SELECT greatest(sum(a), 1) FROM seeds) AS s_t,
    coalesce(b, 0) / (SELECT greatest(sum(b), 1) FROM seeds) AS s_d
  FROM seeds FULL JOIN (SELECT src AS host FROM e UNION SELECT dst FROM e) USING (host)
), ways AS MATERIALIZED (
  SELECT src AS sender, dst AS host, n / n_out AS t_share, 0.0::DOUBLE AS d_share FROM e
  UNION ALL SELECT dst, src, 0.0::DOUBLE, n / n_in FROM e
  UNION ALL SELECT host, host, 0.0::DOUBLE, 0.0::DOUBLE FROM hosts
), r AS (
  SELECT 0 AS k, host, s_t::DOUBLE AS t, s_d::DOUBLE AS d FROM hosts
  UNION ALL
  SELECT r.k + 1, w.host, {1 - damping!r} * any_value(h.s_t) + {damping!r} * sum(r.t * w.t_share),
    {1 - damping!r} * any_value(h.s_d) + {damping!r} * sum(r.d * w.d_share)
  FROM r JOIN ways w ON w.sender = r.host JOIN hosts h ON h.host = w.host WHERE r.k < {rounds} GROUP BY r.k, w.host
)
SELECT page_id, host, path, rule, coalesce(decision, CASE WHEN d > t THEN 'block' ELSE 'allow' END) AS verdict
FROM decided JOIN r USING (host) WHERE k = {rounds}
"""
