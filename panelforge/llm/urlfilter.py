"""URL filters: pattern rules indexed by their rarest literal token; a URL's tokens fetch candidate rules, and only those run."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the rule index that are broadcast at most; a larger index joins by a shuffle.
MAX_BROADCAST_RULES = 100_000


@dataclass(frozen=True)
class Rule:
    """pattern: a Java regular expression over host + path; tokens: the whole tokens that every URL it fits has; rank: the higher wins."""

    name: str | None
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int


def prefix_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits the host and all its subdomains if the path starts with the rule's; of several the longest wins."""
    whole = path.split("/")[:-1]  # what follows the last slash may be part of a longer token
    tokens = tuple(dict.fromkeys(t for t in re.split(r"[^A-Za-z0-9]+", host + "/" + "/".join(whole)) if t))
    return Rule(host + path, verdict, rf"^(?:[^/]*\.)?\Q{host}{path}\E", tokens, 1_000_000 + len(host + path))


def word_rule(words: str, verdict: str = "block") -> Rule:
    """Fits URLs that have the words (parted by - or _ or nothing but a sign) side by side anywhere in host or path."""
    parts = tuple(words.split("-"))
    return Rule(None, verdict, r"(?:^|[^A-Za-z0-9])" + "[^A-Za-z0-9]".join(rf"\Q{p}\E" for p in parts) + r"(?:$|[^A-Za-z0-9])", tuple(p for p in parts if p), 0)


#: The rules of the query.
HOST_RULES = (
    prefix_rule("block", "com", "/en/"),
    prefix_rule("allow", "example.com", "/en/7"),
    prefix_rule("allow", "net", "/de/"),
    prefix_rule("block", "example.net", "/de/8"),
    prefix_rule("block", "org", "/es/"),
)
#: What the method blocks by itself where no rule above fits.
WORD_RULES = tuple(word_rule(w) for w in ("spam-farm", "cheap-pills", "casino", "free-money", "free-bets", "adult", "payday-loans", "keygen", "ads-track"))


def with_host_path(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """pages with host (A-Z lower-cased, other letters as they are) and path; both empty for a null URL or one without ://."""
    url = F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit(""))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "path": path})


def url_verdicts(pages: DataFrame, rules: tuple[Rule, ...] = HOST_RULES + WORD_RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict): the best fitting named rule, or null; its verdict, else block if a nameless rule fits, else allow.

    Each rule waits under that of its tokens which fewest URLs have, counted over all pages for the tokens of the rules alone.
    Rows that repeat an id and URL each get a result; a null id is kept. A rule without a token can't be indexed: ValueError.
    """
    if bare := [r.pattern for r in rules if not r.tokens]:
        raise ValueError(f"rules need a token of letters or digits: {', '.join(bare)}")
    spark = pages.sparkSession
    urls = with_host_path(pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"))).select("page_id", "host", "path")
    whole = F.concat("host", "path")
    tokens = F.array_distinct(F.filter(F.split(whole, "[^A-Za-z0-9]+"), lambda t: t != ""))
    known = sorted({t for r in rules for t in r.tokens})
    seen = urls.select(F.explode(F.array_intersect(tokens, F.array(*map(F.lit, known)))).alias("token")).groupBy("token").count()
    often = {r[0]: r[1] for r in seen.collect()}  # the rules' own tokens only
    index = [(min(r.tokens, key=lambda t: (often.get(t, 0), t)), i, r.name, r.verdict, r.pattern, r.rank) for i, r in enumerate(rules)]
    index = spark.createDataFrame(index, "token string, no int, rule string, verdict string, pattern string, rank int")
    if len(rules) <= MAX_BROADCAST_RULES:
        index = F.broadcast(index)
    fetched = urls.select("host", "path").distinct().select("host", "path", whole.alias("whole"), F.explode(tokens).alias("token")).join(index, "token").where(F.expr("rlike(whole, pattern)"))
    best = fetched.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct("rank", -F.col("no"))).alias("best"))
    out = urls.join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))
