"""Host reputation: labelled page outcomes shrunk from host to registered domain to suffix.

Outcomes (bad or good) are counted per host, then per registered domain, suffix
and over all.  At every level the rate of a unit is the mean of a beta posterior
whose prior has the mean of the level above and a strength estimated over the
units of the level by moments of the beta-binomial: the overdispersion

    rho = (sum (x - n m)^2 - sum n m (1 - m)) / sum n (n - 1) m (1 - m),

kept inside [0.001, 0.999], gives the strength 1 / rho - 1.  A host is blocked
when the lower bound of its posterior (mean - z standard deviations) exceeds the
highest rate of bad pages that is tolerated; a rule that fits decides before.

Counts are summed before any shuffle, so a host with a third of all pages is one
row per task.  Reputations go back to the pages in two ways: hosts that hold at
least one row in `WIDE` (so at most `WIDE` hosts, a bound by construction) are
broadcast, all other hosts are joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from uwspark.staging import stage

from .common import query, table

#: Fixed values of the contract: verdict and prefix (host, then path).
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
#: Suffixes of two labels; any other suffix is the last label.
TWO_LABELS = ["ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "org.uk"]
WIDE = 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    """What follows the first `://`; empty for null or where there is none."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def suffix(host: Column) -> Column:
    name = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    two = F.substring_index(name, ".", -2)
    return F.when(two.isin(TWO_LABELS), two).otherwise(F.substring_index(name, ".", -1))


def domain(host: Column) -> Column:
    name = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    two = F.substring_index(name, ".", -2)
    return F.when(two.isin(TWO_LABELS), F.substring_index(name, ".", -3)).otherwise(two)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null if none does.  Rules are a list in code."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _shrunk(units: DataFrame, prior: str, out: str) -> DataFrame:
    """Add the posterior `out`_a, `out`_b and mean `out` of every unit, given its prior mean."""
    m, n, x = F.col(prior), F.col("n"), F.col("bad")
    spread = m * (1 - m)
    moments = units.agg(
        F.sum((x - n * m) * (x - n * m)).alias("_sq"),
        F.sum(n * spread).alias("_var"),
        F.sum(n * (n - 1) * spread).alias("_pairs"),
    ).select(
        F.lit(1).alias("_one"),
        F.coalesce(
            F.greatest(F.lit(0.001), F.least(F.lit(0.999), (F.col("_sq") - F.col("_var")) / F.nullif(F.col("_pairs"), F.lit(0.0)))),
            F.lit(0.001),
        ).alias("_rho"),
    )
    strength = 1 / F.col("_rho") - 1
    a, b = x + strength * m, n - x + strength * (1 - m)
    return (
        units.withColumn("_one", F.lit(1)).join(F.broadcast(moments), "_one")
        .withColumns({f"{out}_a": a, f"{out}_b": b})
        .withColumn(out, F.col(f"{out}_a") / (F.col(f"{out}_a") + F.col(f"{out}_b")))
        .drop("_one", "_rho")
    )


def reputations(counts: DataFrame, z: float = 1.64) -> DataFrame:
    """One row per host of `counts` (host, n labelled pages, bad): posterior mean and lower bound.

    Hosts without a labelled page get the posterior of their registered domain.  Without
    any label the rate of all is one half.
    """
    host = counts.select("host", domain(F.col("host")).alias("domain"), suffix(F.col("host")).alias("suffix"), "n", "bad")
    domains = host.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    everything = suffixes.agg(((F.sum("bad") + 1) / (F.sum("n") + 2)).alias("rate")).select(
        F.lit(1).alias("_one"), F.coalesce("rate", F.lit(0.5)).alias("rate")
    )
    s = _shrunk(suffixes.withColumn("_one", F.lit(1)).join(F.broadcast(everything), "_one").drop("_one"), "rate", "suffix_rate")
    d = _shrunk(domains.join(s.select("suffix", "suffix_rate"), "suffix"), "suffix_rate", "domain_rate")
    h = _shrunk(host.join(d.select("suffix", "domain", "domain_rate"), ["suffix", "domain"]), "domain_rate", "host_rate")
    a, b = F.col("host_rate_a"), F.col("host_rate_b")
    sd = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return h.select("host", F.col("host_rate").alias("rate"), F.greatest(F.lit(0.0), F.col("host_rate") - z * sd).alias("bound"))


def judge_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: list[tuple[str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    max_bad: float = 0.3,
    z: float = 1.64,
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, posterior rate and bound of its host.

    `outcomes` (id, bad 0/1): at most one counted per id, the worst; ids that are null or
    unknown and null outcomes count nowhere.  A null url and one without `://` have the
    empty host, which is a host like any other.  Rows repeated with one id are judged
    alike.  Empty tables give an empty result.  Other columns are not read.
    """
    base = stage(
        pages.select(F.col(id_col).alias("_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    )
    seen = outcomes.where("id is not null and bad is not null").groupBy("id").agg(F.max("bad").cast("bigint").alias("bad"))
    labelled = base.join(seen, F.col("_id") == F.col("id"), "left")
    counts = labelled.groupBy("host").agg(
        F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.count(F.lit(1)).alias("pages")
    )
    known = stage(
        reputations(counts, z).join(counts.select("host", "pages"), "host")
        .select("host", F.round("rate", 6).alias("host_rate"), F.round("bound", 6).alias("host_bound"), "pages")
    )
    limit = base.count() / WIDE
    wide = known.where(F.col("pages") >= limit).drop("pages")  # at most WIDE rows
    rest = known.where(F.col("pages") < limit).drop("pages")
    judged = base.join(F.broadcast(wide), "host").unionByName(
        base.join(F.broadcast(wide.select("host")), "host", "left_anti").join(rest, "host")
    )
    rule = fitting_rule(F.col("host"), F.col("path"), rules)
    return judged.withColumn("_rule", rule).select(
        F.col("_id").alias(id_col),
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        F.coalesce("_rule.verdict", F.when(F.col("host_bound") > max_bad, "block").otherwise("allow")).alias("verdict"),
        "host_rate",
        "host_bound",
    )


def label_outcomes(labels: DataFrame) -> DataFrame:
    """A labelled page is bad when it is toxic or of low quality."""
    return labels.select(F.col("doc_id").alias("id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int").alias("bad"))


SQL = r"""
with u as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
base as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
seen as (
  select doc_id, max(case when toxic = 1 or quality = 0 then 1 when toxic is null or quality is null then null else 0 end) as bad
  from labels where doc_id is not null group by doc_id),
name as (select *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') as bare from base),
parts as (
  select *, array_to_string(string_split(bare, '.')[-2:], '.') as two, array_to_string(string_split(bare, '.')[-3:], '.') as three,
         string_split(bare, '.')[-1] as one from name),
hosts as (
  select host, case when two in ('ac.uk', 'co.jp', 'co.nz', 'co.uk', 'com.au', 'com.br', 'org.uk') then two else one end as suffix,
         case when two in ('ac.uk', 'co.jp', 'co.nz', 'co.uk', 'com.au', 'com.br', 'org.uk') then three else two end as domain,
         count(bad) as n, coalesce(sum(bad), 0) as bad
  from parts left join seen on page_id = doc_id group by all),
domains as (select suffix, domain, sum(n) as n, sum(bad) as bad from hosts group by all),
suffixes as (select suffix, sum(n) as n, sum(bad) as bad from domains group by all),
g as (select (sum(bad) + 1) / (sum(n) + 2) as m from suffixes),
sk as (
  select 1 / greatest(0.001, least(0.999, coalesce((sum((bad - n * m) * (bad - n * m)) - sum(n * m * (1 - m)))
         / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0.001))) - 1 as k from suffixes, g),
s as (select suffix, (bad + k * m) / (n + k) as m from suffixes, g, sk),
dd as (select domains.*, s.m from domains join s using (suffix)),
dk as (
  select 1 / greatest(0.001, least(0.999, coalesce((sum((bad - n * m) * (bad - n * m)) - sum(n * m * (1 - m)))
         / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0.001))) - 1 as k from dd),
d as (select suffix, domain, (bad + k * m) / (n + k) as m from dd, dk),
hh as (select hosts.*, d.m from hosts join d using (suffix, domain)),
hk as (
  select 1 / greatest(0.001, least(0.999, coalesce((sum((bad - n * m) * (bad - n * m)) - sum(n * m * (1 - m)))
         / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0.001))) - 1 as k from hh),
ab as (select host, bad + k * m as a, n - bad + k * (1 - m) as b from hh, hk),
rep as (
  select host, round(a / (a + b), 6) as host_rate,
         round(greatest(0, a / (a + b) - 1.64 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))), 6) as host_bound from ab),
r as (
  select *, case
    when (host = 'www.example.com' or ends_with(host, '.www.example.com')) and starts_with(path, '/en/') then 'www.example.com/en/'
    when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/es/') then 'net/es/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/') then 'com/' end as rule
  from base join rep using (host))
select page_id, host, path, rule,
       case when rule in ('com/', 'www.example.com/en/') then 'allow' when rule is not null then 'block'
            when host_bound > 0.3 then 'block' else 'allow' end as verdict, host_rate, host_bound
from r
"""


@query("op7_host_reputation", SQL)
def op7(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages"), label_outcomes(table(spark, sf_dir, "labels")), RULES)
