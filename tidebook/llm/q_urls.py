"""Query on URL filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import joined, kept, table
from .urls import ENTITIES, article_of, borne_out, host_of, judge, mine, path_of, squeezed, tokens_of

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tokens, bad and held of each page whose whole article is the text of a labelled document.

    Of several labels of a text, bad is what half or more of them say: low quality or toxic. A page in four, by its url, is
    held back from mining. Stated rules play no part.
    """
    url = F.col("url")
    host, path = F.coalesce(host_of(url), F.lit("")), F.coalesce(path_of(url), F.lit(""))
    pages = table(spark, sf_dir, "pages").select("page_id", tokens_of(url, host, path).alias("tokens"), F.left(F.md5(F.coalesce(url, F.lit(""))), F.lit(1)).isin(*"0123").alias("held"), F.sha2(article_of(F.col("html")), 256).alias("text"))
    bad = table(spark, sf_dir, "labels").groupBy("doc_id").agg((F.max((F.col("quality") == 0).cast("int") + F.col("toxic")) > 0).cast("double").alias("bad"))
    texts = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.nullif(squeezed(F.col("text")), F.lit("")), 256).alias("text"))
    texts = texts.filter("text is not null").join(bad.filter("bad is not null"), "doc_id").groupBy("text").agg((F.avg("bad") >= 0.5).alias("bad"))
    return joined(pages.filter("text is not null"), texts, "text", "page_id").select("tokens", "bad", "held")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = kept(labelled(spark, sf_dir), "labelled-urls")
    mined = borne_out(mine(known.filter("not held").select("tokens", "bad")), known.filter("held"))
    found = judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES, mined)
    return found.select("page_id", "host", "path", "rule", "verdict")


#: The text of an article, as article_of() gives it.
ARTICLE_SQL = r"regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's'), '<h1>.*?</h1>', ' ', 'gs'), '<[^>]*>', ' ', 'g')"
for _name, _sign in ENTITIES:
    ARTICLE_SQL = f"replace({ARTICLE_SQL}, '{_name}', '{_sign.replace(chr(39), chr(39) * 2)}')"
ARTICLE_SQL = rf"trim(regexp_replace({ARTICLE_SQL}, '[\x09-\x0D\x20]+', ' ', 'g'))"

OP2_SQL = r"""
WITH RECURSIVE p AS (SELECT row_number() OVER () AS rid, page_id, url, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT rid, page_id, url, ARTICLE AS article,
             translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
t AS (SELECT h.*, list_sort(list_distinct(list_concat(
        list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || regexp_replace(x, '[0-9]+', '0', 'g')),
        list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: 's:' || regexp_replace(x, '[0-9]+', '0', 'g')),
        list_transform(list_filter(regexp_extract_all(coalesce(url, ''), '[?&]([^=&#]*)', 1), lambda x: x <> ''), lambda x: 'q:' || regexp_replace(x, '[0-9]+', '0', 'g'))))) AS toks,
      CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
           WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
           WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
           WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM h),
lab AS (SELECT doc_id, max(CAST(quality = 0 AS INT) + toxic) > 0 AS bad FROM labels GROUP BY doc_id),
o AS (SELECT trim(regexp_replace(text, '[\x09-\x0D\x20]+', ' ', 'g')) AS article, avg(CAST(bad AS INT)) >= 0.5 AS bad FROM documents JOIN lab USING (doc_id) WHERE bad IS NOT NULL GROUP BY 1),
known AS (SELECT rid, toks, o.bad, substr(md5(coalesce(url, '')), 1, 1) IN ('0', '1', '2', '3') AS held FROM t JOIN o USING (article) WHERE article <> ''),
tr AS (SELECT rid, toks, bad FROM known WHERE NOT held),
ho AS (SELECT toks, bad FROM known WHERE held),
tot AS (SELECT count(*) AS n, greatest(20, ceil(count(*) * 0.001)) AS least, avg(CAST(bad AS INT)) AS base FROM tr),
e AS (SELECT rid, bad, unnest(toks) AS tok, generate_subscripts(toks, 1) AS k FROM tr),
combos AS (SELECT rid, bad, [tok] AS c, k FROM e
           UNION ALL SELECT combos.rid, combos.bad, list_append(c, tok), e.k FROM combos JOIN e ON combos.rid = e.rid AND e.k > combos.k),
found AS (SELECT c, sum(CAST(bad AS INT)) / count(*) AS conf FROM combos, tot GROUP BY c, n, least, base
      HAVING sum(CAST(bad AS INT)) >= least AND sum(CAST(bad AS INT)) >= 0.6 * count(*) AND sum(CAST(bad AS INT)) >= 2.0 * base * count(*)),
pruned AS (SELECT c FROM found a WHERE NOT EXISTS (SELECT 1 FROM found b WHERE len(b.c) < len(a.c) AND list_has_all(a.c, b.c) AND b.conf >= a.conf)),
r AS (SELECT c FROM pruned, ho, (SELECT avg(CAST(bad AS INT)) AS base FROM ho) WHERE list_has_all(ho.toks, c) GROUP BY c, base
      HAVING count(*) >= 5 AND avg(CAST(ho.bad AS INT)) >= 0.6 AND avg(CAST(ho.bad AS INT)) >= 2.0 * base),
hit AS (SELECT DISTINCT rid FROM t, r WHERE list_has_all(t.toks, r.c)),
s AS (SELECT page_id, host, path, rule, hit.rid IS NOT NULL AS mined FROM t LEFT JOIN hit ON t.rid = hit.rid)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN mined THEN 'block' ELSE 'allow' END AS verdict
FROM s
""".replace("ARTICLE", ARTICLE_SQL)

QUERIES = {"op2_url_filters": op2_url_filters}
ORACLE_SQL = {"op2_url_filters": OP2_SQL}
