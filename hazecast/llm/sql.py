"""The SQL that registered queries of this package are checked against (DuckDB)."""

from hazecast.llm.license_texts import EQUIVALENT, KNOWN
from hazecast.llm.licenses import BREAKS, COPYRIGHT_LINE, LOWER, RESERVED, SIGN, UPPER


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(text: str) -> str:
    t = f"chr(10) || translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"
    for pattern, put in ((COPYRIGHT_LINE, ""), (RESERVED, " "), (SIGN, " copyright ")):
        t = f"regexp_replace({t}, {_quoted(pattern)}, {_quoted(put)}, 'g')"
    t = f"regexp_replace(' ' || {t} || ' ', {_quoted(BREAKS)}, '  ', 'g')"
    for spelling, kept in EQUIVALENT:
        t = (f"replace({t}, {_quoted(' ' + spelling.replace(' ', '  ') + ' ')}, "
             f"{_quoted(' ' + kept.replace(' ', '  ') + ' ')})")
    return t


_KNOWN = ", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in KNOWN)
LICENSES = f"""
WITH known AS (SELECT sha256({_canonical('text')}) AS digest, min(license) AS license
               FROM (VALUES {_KNOWN}) AS k(license, text) GROUP BY 1),
ours AS (SELECT doc_id, sha256({_canonical('text')}) AS digest FROM documents)
SELECT doc_id, digest, license FROM ours LEFT JOIN known USING (digest)
"""

MIXING = r"""
WITH rows AS (SELECT doc_id, source,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3
      WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM rows GROUP BY source),
ordered AS (SELECT *, sum(2 * source_size) OVER w AS cap_before, sum(weight) OVER v AS weight_from,
    row_number() OVER (ORDER BY 2e0 * source_size / weight, source NULLS LAST) AS nth
  FROM sources
  WINDOW w AS (ORDER BY 2e0 * source_size / weight, source NULLS LAST
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         v AS (ORDER BY 2e0 * source_size / weight, source NULLS LAST
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
-- with the first nth - 1 sources clamped, the others are below their caps
level AS (SELECT nth, weight_from,
    (SELECT sum(3 * source_size) FROM sources) - 2 * coalesce(cap_before, 0) AS rest,
    weight * ((SELECT sum(3 * source_size) FROM sources) - 2 * coalesce(cap_before, 0))
      <= 2 * source_size * 2 * weight_from AS fits FROM ordered),
first AS (SELECT min(nth) AS nth FROM level WHERE fits),
targets AS (SELECT source, source_size, CASE WHEN o.nth < f.nth OR f.nth IS NULL
      THEN CAST(2 * source_size AS DOUBLE)
      ELSE CAST(weight * l.rest AS DOUBLE) / CAST(2 * l.weight_from AS DOUBLE) END AS target
  FROM ordered o, first f LEFT JOIN level l ON l.nth = f.nth),
parts AS (SELECT r.*, source_size, target, coalesce(floor(target / source_size), 0) AS whole,
    coalesce(sum(size) OVER (PARTITION BY r.source ORDER BY digest, doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * CASE WHEN whole >= 2 THEN 2 ELSE whole
    + CASE WHEN before + size / 2e0 < target - whole * source_size THEN 1 ELSE 0 END END AS BIGINT) AS taken
FROM parts
"""

URLS = r"""
WITH cut AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM cut),
ruled AS (SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/')
    THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""

BM25 = r"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, CAST(count(*) AS DOUBLE) AS tf FROM words GROUP BY ALL),
len AS (SELECT d.doc_id, CAST(coalesce(sum(tf), 0) AS DOUBLE) AS dl FROM documents d LEFT JOIN tf USING (doc_id) GROUP BY 1),
stat AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(dl) / count(*) AS average FROM len),
df AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM tf GROUP BY 1),
impact AS (SELECT tf.doc_id, tf.term, CAST(round(ln((n - df + 0.5e0) / (df + 0.5e0) + 1e0)
      * (tf * (1.2e0 + 1e0) / (tf + 1.2e0 * (1e0 - 0.75e0 + 0.75e0 * dl / average))) * 1e6) AS BIGINT) AS impact
  FROM tf JOIN df USING (term) JOIN len USING (doc_id), stat),
scored AS (SELECT q.doc_id AS query_id, i.doc_id, CAST(sum(impact) AS BIGINT) AS score
  FROM tf q JOIN impact i USING (term) WHERE q.doc_id % 100 = 0 AND q.doc_id <> i.doc_id GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, doc_id, score / 1e6 AS score FROM ranked WHERE rank <= 10
"""

MAX_SCORE = r"""
WITH lowered AS (SELECT {id} AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz') AS text FROM {table}),
words AS (SELECT id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM lowered)
SELECT id, term, CAST(count(*) AS BIGINT) AS tf FROM words GROUP BY ALL
"""
MAX_SCORE = f"""
WITH tf AS ({MAX_SCORE.format(id="doc_id", table="documents")}),
asked AS ({MAX_SCORE.format(id="item_id", table="benchmark")}),
len AS (SELECT id, CAST(sum(tf) AS HUGEINT) AS n FROM tf GROUP BY 1),
stat AS (SELECT CAST(count(*) AS HUGEINT) AS docs, CAST(sum(n) AS HUGEINT) AS words FROM len),
weight AS (SELECT term, CAST(floor(1000e0 * ln((2e0 * docs + 2e0) / (2e0 * count(*) + 1e0))) AS BIGINT) AS w
  FROM tf, stat GROUP BY term, docs),
norm AS (SELECT id, CAST(10 + (90 * n * docs) // words AS BIGINT) AS m FROM len, stat),
scored AS (SELECT a.id AS item_id, t.id AS doc_id,
    CAST(sum(w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * m))) AS BIGINT) AS score
  FROM asked a JOIN tf t USING (term) JOIN weight USING (term) JOIN norm ON norm.id = t.id GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

ORACLES = {"op13_max_score": MAX_SCORE, "op3_bm25": BM25, "op1_license_scan": LICENSES, "op7_mixing": MIXING, "op9_url_rules": URLS}
