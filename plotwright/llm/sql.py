"""SQL equivalents of the training-data queries that SQL can express on whole tables."""

from __future__ import annotations

from plotwright.functions.text import _MARKED, _PLAIN
from plotwright.plans.core_p import PARSED_SQL

_BARE = "regexp_replace(regexp_replace(regexp_replace(trim({}), '[#?].*$', ''), '/+$', ''), '^[a-zA-Z]+://', '')"
_URL = f"regexp_replace(lower(split_part({_BARE}, '/', 1)), '^www\\.', '') || substr({_BARE}, length(split_part({_BARE}, '/', 1)) + 1)"


def _url(c: str) -> str:
    return _URL.replace("{}", c)


def _side(s: str) -> str:
    return f"SELECT pair_id, coalesce('i|' || {s}_source || '|' || trim({s}_source_id), u.name, 'u|' || {_url(f'{s}_url')}) AS name FROM match_pair LEFT JOIN u ON {_url(f'{s}_url')} = u.url WHERE is_match"


P2 = f"""WITH RECURSIVE u AS (SELECT {_url('url')} AS url, min('i|' || source || '|' || source_id) AS name FROM listing WHERE url IS NOT NULL AND url <> '' GROUP BY 1),
    e AS (SELECT l.name AS a, r.name AS b FROM ({_side('left')}) l JOIN ({_side('right')}) r USING (pair_id)), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    reach AS (SELECT a AS v, a AS w FROM s UNION SELECT reach.v, s.b FROM reach JOIN s ON reach.w = s.a),
    ads AS (SELECT source, source_id, 'i|' || source || '|' || source_id AS name, min(seq) AS ad FROM listing WHERE source IS NOT NULL AND source_id IS NOT NULL GROUP BY ALL),
    g AS (SELECT reach.v, min(ads.ad) AS group_seq, count(*) AS n FROM reach JOIN ads ON reach.w = ads.name GROUP BY 1)
    SELECT source, source_id, group_seq FROM ads JOIN g ON g.v = ads.name WHERE n > 1"""

_WORDS = f"list_distinct(list_filter(regexp_split_to_array(translate(lower(coalesce(title, '')), '{_MARKED}', '{_PLAIN}'), '[^a-z0-9]+'), lambda w: w <> ''))"
P3 = f"""WITH r AS (SELECT seq, type, area, price, {_WORDS} AS words, CASE WHEN NOT regexp_matches(lower(image), 'placeholder|brak-zdj|no-photo') THEN nullif(regexp_extract(lower(image), '([0-9a-f]{{14}})', 1), '') END AS picture FROM listing WHERE area > 0 AND price > 0),
    c AS (SELECT x.seq AS seq_a, y.seq AS seq_b, x.picture = y.picture AS seen, len(list_intersect(x.words, y.words)) AS i, len(x.words) + len(y.words) AS n FROM r x JOIN r y ON x.type = y.type AND x.seq < y.seq AND y.area BETWEEN x.area * 0.97 AND x.area * 1.03
      AND abs(x.area - y.area) <= 0.02::DOUBLE * greatest(x.area, y.area) + 1e-9 AND abs(x.price - y.price) <= 0.06::DOUBLE * greatest(x.price, y.price) + 1e-9)
    SELECT seq_a, seq_b FROM c WHERE seen OR (n > i AND i >= 0.6::DOUBLE * (n - i) - 1e-9)"""

_FILLED = " + ".join(f"(CASE WHEN trim(regexp_replace({c}::VARCHAR, '[\\s\\x{{00A0}}]+', '', 'g')) <> '' THEN 1 ELSE 0 END)" for c in ("title", "area", "rooms", "floor", "locality", "district", "street", "agency", "image"))
P7 = f"""WITH {PARSED_SQL}, m AS (SELECT DISTINCT g.group_id, l.seq, l.price, l.source, coalesce(i.created_ms, -4611686018427387904) AS moment, i.created_ms, coalesce(t.rank, 2147483647) AS rank, {_FILLED} AS filled
      FROM dup_group g JOIN listing l USING (seq) LEFT JOIN instants i ON l.created = i.created LEFT JOIN source_trust t ON l.source = t.source)
    SELECT group_id, first(seq ORDER BY filled DESC, rank, moment DESC, seq) AS seq, first(price ORDER BY moment DESC, rank, seq) FILTER (WHERE price > 0) AS price, first(source ORDER BY rank, source) FILTER (WHERE source IS NOT NULL) AS source, max(created_ms) AS created_ms FROM m GROUP BY 1"""


def _grams(table: str, key: str) -> str:
    words = f"list_filter(regexp_split_to_array(translate(lower(text), '{_MARKED}', '{_PLAIN}'), '[^\\pL\\pN]+'), lambda w: w <> '')"
    return f"SELECT DISTINCT {key}, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT {key}, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT {key}, {words} AS w FROM {table}) WHERE len(w) >= 12)"


P9 = f"WITH i AS ({_grams('eval_item', 'item_id')}), d AS ({_grams('documents', 'doc_id')}) SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (g)"

ORACLE = {"p2_found": P2, "p3_found": P3, "p7_found": P7, "p9_found": P9}
