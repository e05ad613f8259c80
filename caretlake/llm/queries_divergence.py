"""Query and SQL of the source divergence audit."""

from __future__ import annotations

from caretlake.llm.common import prepare, table
from caretlake.llm.divergence import source_divergence


def op13_source_divergence(spark, sf_dir):
    return source_divergence(table(prepare(spark), sf_dir, "documents"))


QUERIES = {"op13_source_divergence": op13_source_divergence}
ORACLES = {"op13_source_divergence": r"""
    WITH docs AS (
        SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang,
            coalesce(source, '') AS source, translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
        FROM documents),
    words AS (
        SELECT doc, lang, source,
            unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM docs),
    kept AS (
        SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
    counts AS (
        SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term)
        GROUP BY lang, source, term),
    sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
    groups AS (
        SELECT lang, source, coalesce(v, 0) AS v, coalesce(total, 0) AS total
        FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN sizes USING (lang)
        LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source)
            USING (lang, source)),
    p AS (
        SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n,
            1 + 1000000000::HUGEINT * (coalesce(n, 0) + 1) // (total + v) AS p
        FROM groups g JOIN kept k USING (lang)
        LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    whole AS (
        SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(n) + 1) // (any_value(total) + any_value(v)) AS q
        FROM counts JOIN (SELECT lang, sum(total) AS total, any_value(v) AS v FROM groups
                          GROUP BY lang) USING (lang) GROUP BY lang, term),
    pairs AS (
        SELECT a.lang, a.source, b.source AS item,
            coalesce(f, 0)::BIGINT AS value
        FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN (
            SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS f
            FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source
            GROUP BY ALL) f
            ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
    rows AS (
        SELECT lang, source, 'pair' AS part, item, value FROM pairs
        UNION ALL
        SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT
        FROM p JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
    ranked AS (
        SELECT *, row_number() OVER (
            PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM rows)
    SELECT lang, source, part, item, value, rank FROM ranked
    WHERE part = 'pair' OR rank <= 200"""}
