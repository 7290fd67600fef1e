"""Text of filings: cleaning, identifiers, issuers, times, and checks of structured answers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns: an ISIN of the market, a report number, and endings of company names.
ISIN = r"\b(PL[A-Z0-9]{9}[0-9])\b"
REPORT_NO = r"(?i)\b(?:raport\s+bieżący\s+)?(?:nr|no\.?)\s*([0-9]{1,4}\s*/\s*(?:19|20)[0-9]{2})"
LEGAL_FORMS = r"(?i)[\s,]+(?:spółka akcyjna|s\.?\s?a\.?|sp\.?\s?z\s?o\.?\s?o\.?|n\.?v\.?|plc|se|asi|ltd\.?|inc\.?)$"
ZONE = "Europe/Warsaw"


def strip_html(html: Column) -> Column:
    """Tags become spaces, runs of space one, and the ends are trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", " "), r"\s+", " "))


def content_hash(*parts: Column) -> Column:
    """SHA-256 of the parts, each followed by a zero byte; null counts as empty."""
    return F.sha2(F.concat(*[x for p in parts for x in (F.coalesce(p, F.lit("")), F.lit("\0"))]), 256)


def first_match(pattern: str, *texts: Column) -> Column:
    """Group 1 of the pattern in the first of the texts that has it."""
    return F.coalesce(*[F.nullif(F.regexp_extract(F.coalesce(t, F.lit("")), pattern, 1), F.lit("")) for t in texts])


def isin(*texts: Column) -> Column:
    return first_match(ISIN, *texts)


def report_number(*texts: Column) -> Column:
    """The report's number without spaces."""
    return F.regexp_replace(first_match(REPORT_NO, *texts), r"\s+", "")


def issuer(title: Column, passes: int = 4) -> Column:
    """The two to sixty characters before : or ( without endings that tell a company's legal form."""
    name = F.nullif(F.regexp_extract(F.coalesce(title, F.lit("")), r"^\s*([^:(]{2,60}?)\s*[:(]", 1), F.lit(""))
    for _ in range(passes):
        name = F.regexp_replace(F.btrim(name, F.lit(" ,.-")), LEGAL_FORMS, "")
    return F.nullif(F.btrim(name, F.lit(" ,.-")), F.lit(""))


def channel(default: Column, *texts: Column) -> Column:
    """ESPI or EBI, whichever system the texts name (ESPI first), else default."""
    whole = F.concat_ws(" ", *texts)
    return F.when(whole.rlike(r"(?i)\bESPI\b"), "ESPI").when(whole.rlike(r"(?i)\bEBI\b"), "EBI").otherwise(default)


def published_at(raw: Column, zone: str | None = None) -> Column:
    """The instant of an ISO or mail-style time; without a zone, and for CET and CEST, it is Warsaw time. Null if neither.

    zone: for feeds whose offsets are decoration; what the clock shows is then a time of that zone.
    """
    if zone is not None:
        bare = F.regexp_replace(F.trim(raw), r"^[A-Za-z]{3},\s*", "")
        wall = F.regexp_replace(bare, r"(?i)(?:\s*(?:CET|CEST|GMT|UTC|UT|Z)|\s*[+-]\d{2}:?\d{2})$", "")
        wall = F.regexp_replace(wall, r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}(?::\d{2})?)(?:\.\d+)?$", "$1 $2")
        forms = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "d MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm")
        return F.coalesce(*[F.to_utc_timestamp(F.try_to_timestamp(wall, F.lit(f)), zone) for f in forms])
    bare = F.regexp_replace(F.trim(raw), r"^[A-Za-z]{3},\s*", "")
    named = F.regexp_replace(bare, r"\s+(CET|CEST)$", "")
    zoned = F.regexp_replace(bare, r"\s+(GMT|UTC|UT|Z)$", " +0000")
    iso = F.regexp_replace(F.trim(raw), r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}(?::\d{2})?)(?:\.\d+)?", "$1 $2")
    local = F.coalesce(*[F.to_utc_timestamp(F.try_to_timestamp(x, F.lit(p)), ZONE) for x, p in ((iso, "yyyy-MM-dd HH:mm:ss"), (iso, "yyyy-MM-dd HH:mm"), (named, "d MMM yyyy HH:mm:ss"), (named, "d MMM yyyy HH:mm"))])
    exact = F.coalesce(*[F.try_to_timestamp(x, F.lit(p)) for x, p in ((F.regexp_replace(iso, "Z$", "+00:00"), "yyyy-MM-dd HH:mm:ssXXX"), (zoned, "d MMM yyyy HH:mm:ss Z"), (zoned, "d MMM yyyy HH:mm Z"))])
    return F.coalesce(exact, local)


def item_key(guid: Column, link: Column, *parts: Column) -> Column:
    """What an item is known by: its guid, else its link, else the hash of its parts; blanks count as none."""
    some = lambda x: F.nullif(F.trim(x), F.lit(""))
    return F.coalesce(some(guid), some(link), content_hash(*parts))


def end_of_day(date: Column) -> Column:
    """The last second of a Warsaw day, as an instant."""
    return F.to_utc_timestamp(F.date_add(date, 1).cast("timestamp"), ZONE) - F.expr("INTERVAL 1 SECOND")


def normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def quoted(quote: Column, text: Column) -> Column:
    """Is the quote, space and case aside, part of the text? An empty one isn't."""
    q = normal(F.coalesce(quote, F.lit("")))
    return (q != "") & F.contains(normal(F.coalesce(text, F.lit(""))), q)


def penalized(confidence: Column, ok: Column, factor: float = 0.5) -> Column:
    return F.when(ok, confidence).otherwise(F.round(confidence * factor, 6))


def verdict_score(verdict: Column, conviction: Column) -> Column:
    """The verdict's sign times conviction, within -1 and 1; null for an unknown verdict or conviction."""
    sign = F.when(verdict == "bullish", 1.0).when(verdict == "bearish", -1.0).when(verdict == "neutral", 0.0)
    score = sign * conviction
    return F.when(score.isNotNull(), F.greatest(F.least(score, F.lit(1.0)), F.lit(-1.0)))


def relevance_score(label: Column) -> Column:
    return F.when(label == "relevant", 1.0).when(label == "uncertain", 0.0).when(label == "irrelevant", -1.0)


def strict_json(text: Column, numbers: dict[str, tuple[float, float]], enums: dict[str, Iterable[str]], strings: Iterable[str] = (), lists: Iterable[str] = ()) -> Column:
    """Is the text a JSON object of exactly these fields, of these types, ranges and values?"""
    v = F.try_parse_json(text)
    get = lambda name, kind: F.try_variant_get(v, f"$.{name}", kind)
    raw = lambda name: F.get_json_object(text, f"$.{name}")
    fields = sorted([*numbers, *enums, *strings, *lists])
    ok = v.isNotNull() & (F.sort_array(F.json_object_keys(text)) == F.array(*[F.lit(f) for f in fields]))
    for name, (low, high) in numbers.items():
        ok &= F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")).rlike("^(BIGINT|DOUBLE|DECIMAL)") & get(name, "double").between(low, high)
    for name, values in enums.items():
        ok &= raw(name).isin(*values)
    for name in strings:
        ok &= F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")) == "STRING"
    for name in lists:
        ok &= F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")).isin("ARRAY<STRING>", "ARRAY<VOID>")
    return F.coalesce(ok, F.lit(False))


def call_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Prices are for a million tokens."""
    return tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out
