"""The training-data queries of the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plotwright.operators.timestamps import normalize_instants
from plotwright.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable ``listing.created`` values as milliseconds since the epoch."""
    rows = table(spark, sf_dir, "listing").select("seq", "source", "created")
    return normalize_instants(rows).select("seq", "created_ms")


_MONTHS = ("sty|jan", "lut|feb", "mar", "kwi|apr", "maj|may", "cze|jun", "lip|jul", "sie|aug", "wrz|sep", "paź|oct", "lis|nov", "gru|dec")
_ZONE = r"(z|utc|gmt|cet|cest|[+-]\d{2}:?\d{0,2})?(?:\[europe/warsaw\])?"
_ISO = rf"^(\d{{4}})[-.](\d{{2}})[-.](\d{{2}})(?:[t ](\d{{2}}):(\d{{2}})(?::(\d{{2}})(?:[.,](\d{{1,6}}))?)? ?{_ZONE})?$"
_DMY = rf"^(\d{{1,2}})[-./](\d{{1,2}})[-./](\d{{4}})(?: (\d{{2}}):(\d{{2}})(?::(\d{{2}}))? ?(am|pm)? ?{_ZONE})?$"
_COMPACT = r"^(\d{4})(\d{2})(\d{2})t?(\d{2})(\d{2})(\d{2})(z)?$"
_CLOCK_FIRST = r"^(\d{2}):(\d{2}) (\d{2})\.(\d{2})\.(\d{2})$"


def _months(x: str) -> str:
    for i, names in enumerate(_MONTHS, 1):
        x = f"regexp_replace({x}, '^(\\d{{1,2}}) (?:{names})\\S*? (\\d{{4}})', '\\1.{i:02d}.\\2')"
    return x


#: An independent reading: strings to fields by pattern, Warsaw time by the rule of last Sundays at 01:00 UTC.
PARSED_SQL = f"""raw AS (SELECT DISTINCT created, lower(trim(regexp_replace(created, '[\\s\\x{{00A0}}]+', ' ', 'g'))) AS t FROM listing WHERE created IS NOT NULL),
    tidy AS (SELECT created, {_months("regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '^dodano: ', ''), '^[a-z]{3}, ', ''), ' r[.]$', ''), ', (?:godz[.] )?', ' ')")} AS t FROM raw),
    f AS (SELECT created, t, CASE WHEN regexp_matches(t, '{_ISO}') THEN 'iso' WHEN regexp_matches(t, '{_DMY}') THEN 'dmy' WHEN regexp_matches(t, '{_COMPACT}') THEN 'compact' WHEN regexp_matches(t, '{_CLOCK_FIRST}') THEN 'clock' END AS k FROM tidy),
    p AS (SELECT created, t, k,
      CASE k WHEN 'iso' THEN regexp_extract(t, '{_ISO}', 1) WHEN 'dmy' THEN regexp_extract(t, '{_DMY}', 3) WHEN 'compact' THEN regexp_extract(t, '{_COMPACT}', 1) ELSE '20' || regexp_extract(t, '{_CLOCK_FIRST}', 5) END AS y,
      CASE k WHEN 'iso' THEN regexp_extract(t, '{_ISO}', 2) WHEN 'dmy' THEN regexp_extract(t, '{_DMY}', 2) WHEN 'compact' THEN regexp_extract(t, '{_COMPACT}', 2) ELSE regexp_extract(t, '{_CLOCK_FIRST}', 4) END AS m,
      CASE k WHEN 'iso' THEN regexp_extract(t, '{_ISO}', 3) WHEN 'dmy' THEN regexp_extract(t, '{_DMY}', 1) WHEN 'compact' THEN regexp_extract(t, '{_COMPACT}', 3) ELSE regexp_extract(t, '{_CLOCK_FIRST}', 3) END AS d,
      coalesce(TRY_CAST(CASE k WHEN 'iso' THEN regexp_extract(t, '{_ISO}', 4) WHEN 'dmy' THEN regexp_extract(t, '{_DMY}', 4) WHEN 'compact' THEN regexp_extract(t, '{_COMPACT}', 4) ELSE regexp_extract(t, '{_CLOCK_FIRST}', 1) END AS INT), 0) AS hh,
      coalesce(TRY_CAST(CASE k WHEN 'iso' THEN regexp_extract(t, '{_ISO}', 5) WHEN 'dmy' THEN regexp_extract(t, '{_DMY}', 5) WHEN 'compact' THEN regexp_extract(t, '{_COMPACT}', 5) ELSE regexp_extract(t, '{_CLOCK_FIRST}', 2) END AS INT), 0) AS mi,
      coalesce(TRY_CAST(CASE k WHEN 'iso' THEN regexp_extract(t, '{_ISO}', 6) WHEN 'dmy' THEN regexp_extract(t, '{_DMY}', 6) WHEN 'compact' THEN regexp_extract(t, '{_COMPACT}', 6) END AS INT), 0) AS ss,
      coalesce(TRY_CAST(left(rpad(CASE k WHEN 'iso' THEN regexp_extract(t, '{_ISO}', 7) ELSE '' END, 3, '0'), 3) AS INT), 0) AS ms,
      CASE k WHEN 'dmy' THEN regexp_extract(t, '{_DMY}', 7) ELSE '' END AS half,
      CASE k WHEN 'iso' THEN regexp_extract(t, '{_ISO}', 8) WHEN 'dmy' THEN regexp_extract(t, '{_DMY}', 8) WHEN 'compact' THEN regexp_extract(t, '{_COMPACT}', 7) ELSE '' END AS z FROM f WHERE k IS NOT NULL),
    l AS (SELECT created, z, TRY_CAST(y || '-' || lpad(m, 2, '0') || '-' || lpad(d, 2, '0') AS DATE) AS day, CASE half WHEN 'pm' THEN hh % 12 + 12 WHEN 'am' THEN hh % 12 ELSE hh END AS hh, mi, ss, ms FROM p),
    w AS (SELECT created, z, day, datediff('day', DATE '1970-01-01', day)::BIGINT * 86400000 + (hh * 3600 + mi * 60 + ss)::BIGINT * 1000 + ms AS local,
      make_date(year(day), 3, 31) - dayofweek(make_date(year(day), 3, 31))::INT AS spring, make_date(year(day), 10, 31) - dayofweek(make_date(year(day), 10, 31))::INT AS autumn FROM l WHERE day IS NOT NULL AND hh <= 23 AND mi <= 59 AND ss <= 59),
    instants AS (SELECT created, CASE WHEN z IN ('z', 'utc', 'gmt') THEN local WHEN z = 'cet' THEN local - 3600000 WHEN z = 'cest' THEN local - 7200000
      WHEN z <> '' THEN local - CASE WHEN z[1] = '-' THEN -1 ELSE 1 END * (z[2:3]::INT * 60 + coalesce(TRY_CAST(right(replace(z, ':', '')[4:], 2) AS INT), 0)) * 60000::BIGINT
      ELSE local - CASE WHEN local - 7200000 >= datediff('day', DATE '1970-01-01', spring)::BIGINT * 86400000 + 3600000 AND local - 7200000 < datediff('day', DATE '1970-01-01', autumn)::BIGINT * 86400000 + 3600000 THEN 7200000 ELSE 3600000 END END AS created_ms FROM w
      UNION ALL SELECT created, CASE WHEN length(t) = 10 THEN t::BIGINT * 1000 ELSE t::BIGINT END FROM tidy WHERE regexp_full_match(t, '\\d{{10}}|\\d{{13}}'))"""

QUERIES = {"p1_found": p1_found}
ORACLE: dict[str, str] = {"p1_found": f"WITH {PARSED_SQL} SELECT seq, created_ms FROM listing JOIN instants USING (created)"}
