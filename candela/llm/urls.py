"""URL rules, indexed by their rarest literal token.

A rule is a host (with all its subdomains) and the beginning of a path; it
becomes a regular expression over host, NUL and path. Its literal tokens are
the labels of its host and the complete segments of its path; it is indexed by
the one that is rarest in the URLs at hand. A URL's tokens fetch candidate
rules, and only those run their expressions. A rule without a literal token is
filed under a token that every URL has, so it is always tried.

Defined results: a null URL, or one without "://", has an empty host and path
and fits no rule; of the rules that fit the longest (host and path together)
wins, and among equally long ones the first given; pages that repeat are each
judged. Other columns don't matter.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.llm.common import ascii_lower

#: More rules than this aren't broadcast.
BROADCAST_RULES = 50_000
ANY = ""


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def regex(self) -> str:
        return f"^(?s:.*\\.)?{re.escape(self.host)}\\x00{re.escape(self.path)}"

    @property
    def tokens(self) -> list[str]:
        """host: and path: keep a label and a segment of the same name apart; a path's last, open segment is no token."""
        return [f"h:{x}" for x in self.host.split(".") if x] + [f"p:{x}" for x in self.path.split("/")[:-1] if x]


#: Used where no given rule fits: labels that stand for spam hosts.
SPAM_LABELS = ("spam-farm", "cheap-pills", "free-casino")


def host_of(url: Column) -> Column:
    return F.when(url.contains("://"), ascii_lower(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1))).otherwise("")


def path_of(url: Column) -> Column:
    return F.when(url.contains("://"), F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise("")


def tokens_of(host: Column, path: Column) -> Column:
    labels = F.transform(F.split(host, "\\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(labels, segments, F.array(F.lit(ANY))))


def judge(pages: DataFrame, rules: list[Rule], page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule (null if none of the rules fits), verdict."""
    spark = pages.sparkSession
    own = pages.select(F.col(page_id).alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"))
    own = own.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    places = own.select("host", "path").distinct().withColumn("tokens", tokens_of(F.col("host"), F.col("path")))

    literal = spark.createDataFrame([(i, t) for i, r in enumerate(rules) for t in (r.tokens or [ANY])], "rule int, token string")
    literal = F.broadcast(literal) if len(rules) <= BROADCAST_RULES else literal
    seen = places.select(F.explode("tokens").alias("token")).join(literal.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("seen"))
    rarest = literal.join(seen, "token", "left").groupBy("rule").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "token"))["token"].alias("token"))
    bodies = spark.createDataFrame([(i, r.verdict, r.name, r.regex, len(r.name)) for i, r in enumerate(rules)], "rule int, rule_verdict string, name string, regex string, long int")
    index = rarest.join(bodies, "rule")
    index = F.broadcast(index) if len(rules) <= BROADCAST_RULES else index

    fits = (
        places.select("host", "path", F.explode("tokens").alias("token"))
        .join(index, "token")
        .filter(F.regexp(F.concat("host", F.lit("\0"), "path"), F.col("regex")))
        .groupBy("host", "path")
        .agg(F.max(F.struct("long", (-F.col("rule")).alias("first"), "name", "rule_verdict")).alias("best"))
    )
    spam = F.arrays_overlap(F.split("host", "\\."), F.array(*map(F.lit, SPAM_LABELS)))
    return own.join(fits, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.name").alias("rule"), F.coalesce("best.rule_verdict", F.when(spam, "block").otherwise("allow")).alias("verdict")
    )


def oracle(rules: list[Rule]) -> str:
    fits = " union all ".join(
        f"select page_id, host, path, '{r.name}' as rule, '{r.verdict}' as verdict, {len(r.name)} as long, {-i} as first from places"
        f" where (host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}')"
        for i, r in enumerate(rules)
    )
    spam = ", ".join(f"'{x}'" for x in SPAM_LABELS)
    return f"""
with whole as (select page_id, coalesce(url, '') as url from pages),
rest as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) end as rest from whole),
places as (
  select row_number() over () as k, page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from rest),
fits as ({fits.replace("select page_id,", "select k, page_id,")}),
best as (select k, arg_max(rule, [long, first]) as rule, arg_max(verdict, [long, first]) as verdict from fits group by k)
select page_id, host, path, rule, coalesce(verdict, case when list_has_any(string_split(host, '.'), [{spam}]) then 'block' else 'allow' end) as verdict
from places left join best using (k)
"""
