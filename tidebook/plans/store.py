"""Queries on the score store and the guards, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import guards, research, scoring, stored
from ..sources import files
from ..sources import market as m
from ..storage import scratch
from ..tables import Table
from .features import r

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rule(full_text: str) -> dict:
    """Stands in for a model: long filings are relevant, and the quote is the filing's beginning, now and then garbled."""
    n = len(full_text)
    return {"relevance": "relevant" if n > 500 else "irrelevant", "sentiment": (n % 200) / 100 - 1, "confidence": (n % 97) / 96, "quote": full_text[:20] if n % 5 else "no such words here"}


SCORES = """SELECT filing_id, instrument_id, CASE WHEN length(full_text) > 500 THEN 'relevant' ELSE 'irrelevant' END AS relevance, (length(full_text) % 200) / 100.0::DOUBLE - 1 AS sentiment,
 CASE WHEN length(full_text) % 5 <> 0 AND trim(full_text) <> '' THEN (length(full_text) % 97) / 96.0::DOUBLE ELSE round((length(full_text) % 97) / 96.0::DOUBLE * 0.5, 6) END AS confidence FROM filings"""


@query(m.sql("SELECT instrument_id, max(confidence) AS confidence, arg_max(filing_id, (confidence, -filing_id)) AS filing_id FROM (SELECT filing_id, instrument_id, relevance, round(confidence, 6) AS confidence FROM scores) WHERE instrument_id IS NOT NULL GROUP BY instrument_id", "filings", scores=SCORES))
def best_scores(spark, sf_dir):
    """Filings scored by a rule, checked against their quotes; the most confident one of each instrument."""
    f = m.filings(spark, sf_dir)
    g = r(research.grounded(research.scored(f, rule), f), "confidence")
    return research.best(g).select("instrument_id", "confidence", "filing_id")


@query("""WITH c AS (SELECT event_id AS id, ts AS called, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS usd, event_id % 4 = 0 AS cached FROM events),
 s AS (SELECT *, coalesce(sum(CASE WHEN cached THEN 0 ELSE usd END) OVER (PARTITION BY date_trunc('month', called) ORDER BY called, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM c)
 SELECT id, spent, cached OR spent < 20000 AS allowed FROM s""")
def budget_cap(spark, sf_dir):
    e = m.table(spark, sf_dir, "events")
    calls = e.select(F.col("event_id").alias("id"), F.col("ts").alias("at"), F.get_json_object("props", "$.k").cast("double").alias("usd"), (F.col("event_id") % 4 == 0).alias("cached"))
    return research.within_budget(calls, 20_000.0).select("id", "spent", "allowed")


@query("SELECT sha256(text) AS input_hash, min(doc_id) AS id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0) GROUP BY 1")
def cache_misses(spark, sf_dir):
    """Texts whose answer isn't cached (those of every third document are), each once."""
    f = m.filings(spark, sf_dir).select(F.col("filing_id").alias("id"), F.col("content_hash").alias("input_hash"))
    cache = f.filter("id % 3 = 0").select("input_hash", F.lit("{}").alias("response")).distinct()
    return research.through_cache(f, cache)[1]


@query(m.sql("SELECT CASE WHEN instrument_id <= 20 THEN instrument_id END AS instrument_id, count(*) AS n, min(n_chars) AS first_n FROM filings WHERE filing_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1", "filings"))
def unmapped_backlog(spark, sf_dir):
    """Waiting filings by instrument; ids above 20 stand for indices, which count as unmapped."""
    done = m.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("filing_id"))
    f = m.filings(spark, sf_dir).join(done, "filing_id", "left_anti").withColumn("published_at", F.col("n_chars"))
    i = m.instruments(spark, sf_dir).select("instrument_id", (F.col("instrument_id") > 20).alias("is_index"))
    return research.backlog(f, i).withColumnRenamed("first_at", "first_n")


@query("""WITH f AS (SELECT doc_id, source, lang, CASE WHEN doc_id % 7 <> 0 THEN CAST(n_chars % 50 AS VARCHAR) END AS report_no FROM documents),
 a AS (SELECT *, row_number() OVER (PARTITION BY source, report_no, lang ORDER BY doc_id) AS k FROM f)
 SELECT doc_id AS filing_id FROM a WHERE report_no IS NULL OR (k = 1 AND (source, report_no, lang) NOT IN (SELECT source, report_no, lang FROM f WHERE doc_id < 50 AND report_no IS NOT NULL))""")
def cross_source_dedup(spark, sf_dir):
    """Reports that aren't repeats of an earlier one or of a stored one (the first fifty documents)."""
    d = m.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("filing_id"), F.col("source").alias("isin"), F.col("lang").alias("kind"), F.when(F.col("doc_id") % 7 != 0, (F.col("n_chars") % 50).cast("string")).alias("report_no"), F.col("doc_id").alias("published_at"))
    return guards.first_reports(d, d.filter("filing_id < 50 and report_no is not null")).select("filing_id")


@query("SELECT event_id, CASE WHEN hour(ts) >= 18 THEN ts::DATE ELSE ts::DATE - 1 END AS last_day, isodow(ts) <= 5 AND strftime(ts, '%H:%M') BETWEEN '09:00' AND '17:05' AS in_session FROM events")
def session_window(spark, sf_dir):
    e = m.table(spark, sf_dir, "events")
    return e.select("event_id", guards.ingest_end(F.col("ts")).alias("last_day"), guards.in_session(F.col("ts"), [0, 1, 2, 3, 4], "09:00", "17:05").alias("in_session"))


@query("""WITH RECURSIVE t AS (SELECT DISTINCT p_brand AS ticker, ('0x' || right(sha256(p_brand), 8))::BIGINT AS seed, ends_with(p_brand, '1') AS is_index FROM part),
 days AS (SELECT i, row_number() OVER (ORDER BY i) AS k FROM range(0, 430) r(i) WHERE isodow(DATE '2015-01-01' + CAST(i AS INT)) <= 5),
 p AS (SELECT ticker, seed, CASE WHEN is_index THEN 2000.0::DOUBLE ELSE 100.0::DOUBLE + seed % 80 END AS base, 0::BIGINT AS k, -1::BIGINT AS i, CASE WHEN is_index THEN 2000.0::DOUBLE ELSE 100.0::DOUBLE + seed % 80 END AS price FROM t
  UNION ALL SELECT ticker, seed, base, d.k, d.i, greatest(1.0::DOUBLE, price * (1 + (0.0004::DOUBLE + seed % 7 * 0.00005::DOUBLE)) + (sin((seed % 1000 + d.i) / 17.0::DOUBLE) * 0.4::DOUBLE + cos((seed % 333 + d.i) / 9.0::DOUBLE) * 0.3::DOUBLE) * 0.05::DOUBLE * base / 100.0::DOUBLE) FROM p JOIN days d ON d.k = p.k + 1 AND d.k <= 300)
 SELECT ticker, DATE '2015-01-01' + CAST(i AS INT) AS date, round(price, 4) AS close, CAST(200000 + i % 60 * 3000 AS DOUBLE) AS volume FROM p WHERE k > 0""")
def demo_market(spark, sf_dir):
    """Made-up bars of all brands, those that end in 1 being indices: 300 sessions."""
    names = m.table(spark, sf_dir, "part").select(F.col("p_brand").alias("ticker"), F.col("p_brand").endswith("1").alias("is_index")).distinct()
    return files.demo_bars(names, 300).select("ticker", "date", "close", "volume")


@query("""WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey + 7 END AS decision_id FROM orders WHERE o_orderstatus = 'P'),
 good AS (SELECT * FROM o WHERE decision_id IS NULL OR decision_id IN (SELECT o_orderkey FROM orders))
 SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS id, o_orderkey AS user_id, decision_id FROM good""")
def override_journal(spark, sf_dir):
    """Overrides of decisions, of which those that don't exist are refused; written twice, they are there once."""
    o = m.table(spark, sf_dir, "orders")
    asked = o.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("user_id"), F.col("o_orderdate").alias("at"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderkey") + 7).alias("decision_id"), F.lit("skip").alias("action"), F.lit(None).cast("string").alias("reason"))
    t = Table(spark, scratch(spark, "overrides"), ["id"], buckets=4)
    for _ in range(2):
        stored.append_overrides(t, asked, o.select(F.col("o_orderkey").alias("id")), ("day", 1))
    return t.read().select("id", "user_id", "decision_id")


def job_stage(k: int, fails: str) -> str:
    """SQL of a run over what the one before left: claims in turn, those that are admitted, and what came of them."""
    return f"""SELECT h, first, n, usd, attempts + CASE WHEN admitted AND ({fails}) THEN 1 ELSE 0 END AS attempts, ok OR (admitted AND NOT ({fails})) AS ok FROM (
 SELECT *, NOT ok AND attempts < 3 AND spent + coalesce(sum(CASE WHEN ok OR attempts >= 3 THEN 0 ELSE usd END) OVER (ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < cap AS admitted
 FROM s{k}, (SELECT coalesce(sum(usd) FILTER (ok), 0) AS spent FROM s{k}), (SELECT sum(usd) * 0.6::DOUBLE AS cap FROM s0))"""


FAILS = ["n % 3 = 0", "n % 6 = 0", "false"]
STAGES = {"s0": "SELECT sha256(coalesce(text, '')) AS h, min(doc_id) AS first, any_value(length(coalesce(text, ''))) AS n, any_value(1.0::DOUBLE + length(coalesce(text, ''))) AS usd, 0 AS attempts, false AS ok FROM documents GROUP BY 1"} | {f"s{k + 1}": job_stage(k, f) for k, f in enumerate(FAILS)}


@query(m.sql("SELECT doc_id AS filing_id, attempts, ok AS processed, CASE WHEN ok THEN CASE WHEN n > 500 THEN 'relevant' ELSE 'irrelevant' END END AS relevance FROM documents JOIN s3 ON sha256(coalesce(text, '')) = h", **STAGES))
def scoring_job(spark, sf_dir):
    """Filings scored in three runs by a rule that fails on some texts at first, on a budget of three fifths of what all would cost."""
    d = m.filings(spark, sf_dir).select("filing_id", F.timestamp_seconds("filing_id").alias("published_at"), "full_text", F.lit(False).alias("processed"), F.lit(0).alias("attempts"))
    stored = scoring.tables(spark, scratch(spark, "scoring"), buckets=4)
    stored["filings"].upsert(d)
    usd = 1.0 + F.length(F.coalesce("full_text", F.lit("")))
    cap = 0.6 * (d.select("full_text", F.coalesce("full_text", F.lit("")).alias("t")).select("t").distinct().agg(F.sum(1.0 + F.length("t"))).first()[0] or 0.0)
    for every in (3, 6, 0):
        scoring.run(stored, lambda t, every=every: None if every and len(t) % every == 0 else rule(t), F.timestamp_seconds(F.lit(10**9)), cap, usd, steps=1)
    scores = stored["scores"].read().select("filing_id", "relevance")
    return stored["filings"].read().select("filing_id", "attempts", "processed").join(scores, "filing_id", "left")
