"""URL filters: stated rules, then token combinations that FP-growth mines from labels. Built-in functions only."""

from __future__ import annotations

import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, small

BAD = "label=bad"
#: Entities of texts in pages, the one of & last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&amp;", "&"))


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://, and for null."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; empty without ://, and for null."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """A url's distinct tokens: labels of its host, segments of its path and keys of its query; digits count as one 0."""
    plain = lambda x: F.regexp_replace(x, r"[0-9]+", "0")
    some = lambda a, kind: F.transform(F.filter(a, lambda x: x != ""), lambda x: F.concat(F.lit(kind), plain(x)))
    keys = F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]*)"), F.lit(1))
    return F.array_distinct(F.concat(some(F.split(host, r"\."), "h:"), some(F.split(path, "/"), "s:"), some(keys, "q:")))


def stated(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The rule (action, string) that fits, as a struct; null if none does.

    A rule's string is its host and path. It fits its host and all subdomains, if the path starts with the rule's; of
    several the longest string wins, of equal ones the first.
    """
    out = None
    for action, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + start)
        value = F.struct(F.lit(action).alias("action"), F.lit(rule).alias("rule"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<action:string,rule:string>")


def mine(labelled: DataFrame, least_rows: int = 20, support: float = 0.001, confidence: float = 0.6, lift: float = 2.0, longest: int | None = None) -> DataFrame:
    """Combinations of tokens that foretell a bad label: tokens, confidence, lift, rows; none from an empty table.

    labelled: tokens, bad. FP-growth counts all sets of tokens with the label that occur in least_rows rows and in a
    share of support of all rows at least. Of these the ones of enough confidence and lift stay, however many tokens
    they have (unless longest says otherwise), and among them those of which no part is a rule of as much confidence.
    Rows with null tokens don't count, null labels count as good; repeated rows count as often as they stand there.
    """
    labelled = labelled.filter("tokens is not null")
    n = labelled.count()
    spark = labelled.sparkSession
    empty = spark.createDataFrame([], "tokens array<string>, confidence double, lift double, rows long")
    least = max(least_rows, -int(-n * support // 1))
    if n < least:
        return empty
    rows = labelled.select(F.when(F.col("bad"), F.array_append("tokens", F.lit(BAD))).otherwise(F.col("tokens")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n, minConfidence=confidence).fit(rows)
    found = model.associationRules.filter((F.col("consequent") == F.array(F.lit(BAD))) & (F.col("lift") >= lift))
    if longest is not None:
        found = found.filter(F.size("antecedent") <= longest)
    rules = kept(found.select(F.sort_array("antecedent").alias("tokens"), "confidence", "lift", F.round(F.col("support") * n).cast("long").alias("rows")), "url-rules")
    part = rules.select(F.explode("tokens").alias("t"), F.col("tokens").alias("inner"), F.col("confidence").alias("c"))
    wider = rules.select(F.explode("tokens").alias("t"), "tokens", "confidence")
    covered = wider.join(part, "t").filter((F.size("inner") < F.size("tokens")) & (F.size(F.array_except("inner", "tokens")) == 0) & (F.col("c") >= F.col("confidence"))).select("tokens").distinct()
    return rules.join(covered, "tokens", "left_anti")


def _at_rarest(rules: DataFrame) -> DataFrame:
    """tokens of each rule and token, the one that fewest rules hold: an inverted index with each rule in one list."""
    each = rules.select("tokens", F.explode("tokens").alias("token"))
    return each.join(each.groupBy("token").agg(F.count(F.lit(1)).alias("n")), "token").groupBy("tokens").agg(F.min_by("token", F.struct("n", "token")).alias("token"))


def borne_out(mined: DataFrame, held: DataFrame, least_rows: int = 5, confidence: float = 0.6, lift: float = 2.0) -> DataFrame:
    """The mined rules that labels they were not mined from bear out.

    held: tokens, bad. Of its rows that have all tokens of a rule there must be least_rows, and they must be bad in a share of
    confidence, and of lift times the share of all held rows, at least. Without held rows no rule is borne out.
    """
    rows = held.withColumn("_row", F.monotonically_increasing_id()).select("_row", "bad", F.col("tokens").alias("own"), F.explode("tokens").alias("token"))
    met = rows.join(small(_at_rarest(mined)), "token").filter(F.size(F.array_except("tokens", "own")) == 0)
    seen = met.groupBy("tokens").agg(F.count(F.lit(1)).alias("_n"), F.avg(F.col("bad").cast("int")).alias("_share"))
    base = held.agg(F.avg(F.col("bad").cast("int")).alias("_base"))
    good = seen.join(F.broadcast(base)).filter((F.col("_n") >= least_rows) & (F.col("_share") >= confidence) & (F.col("_share") >= lift * F.col("_base")))
    return mined.join(good.select("tokens"), "tokens", "left_semi")


def article_of(html: Column) -> Column:
    """The text of a page's article without its heading: tags count as blanks, runs of white space as one; null without one."""
    body = F.regexp_extract(html, r"(?s)<article>(.*?)</article>", 1)
    bare = F.regexp_replace(F.regexp_replace(body, r"(?s)<h1>.*?</h1>", " "), r"<[^>]*>", " ")
    for name, sign in ENTITIES:
        bare = F.replace(bare, F.lit(name), F.lit(sign))
    return F.nullif(squeezed(bare), F.lit(""))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\x09-\x0D\x20]+", " "))


def judge(pages: DataFrame, rules: list[tuple[str, str]], mined: DataFrame) -> DataFrame:
    """page_id, url, host, path, rule and verdict of every row of pages (page_id, url).

    A stated rule decides where one fits; elsewhere a url is blocked if all tokens of a mined rule are among its own.
    Mined rules are found by an inverted index: each stands under its token that fewest rules hold, and is compared
    whole where a url has that token. Each distinct url is looked up once. A null url has no token and is allowed, an empty one
    too; repeated rows get the same verdict; a very long url has as many tokens as it has parts. Other columns of pages are
    left out. An empty table stays empty.
    """
    d = pages.select("page_id", "url").withColumns({"host": F.coalesce(host_of(F.col("url")), F.lit("")), "path": F.coalesce(path_of(F.col("url")), F.lit(""))})
    d = d.withColumn("_rule", stated(F.col("host"), F.col("path"), rules))
    said = lambda other: d.select("page_id", "url", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.action", other).alias("verdict"))
    mined = kept(mined, "url-rules-kept")
    if mined.isEmpty():
        return said(F.lit("allow"))
    rare = _at_rarest(mined)
    open_urls = d.filter("_rule is null and url is not null").select("url", "host", "path").distinct()
    looked = open_urls.select("url", tokens_of(F.col("url"), F.col("host"), F.col("path")).alias("own")).select("url", "own", F.explode("own").alias("token"))
    blocked = looked.join(small(rare), "token").filter(F.size(F.array_except("tokens", "own")) == 0).select("url").distinct()
    d = d.join(blocked.withColumn("_hit", F.lit(True)), "url", "left")
    return said(F.when(F.col("_hit"), "block").otherwise("allow"))
