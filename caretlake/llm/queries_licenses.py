"""Query and SQL of the license scan."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from caretlake.llm.common import prepare, table
from caretlake.llm.licenses import NOTICES, PHRASES, scan_licenses


def op1_license_scan(spark, sf_dir):
    docs = table(prepare(spark), sf_dir, "documents")
    first = F.col("phrases.first_word")
    return scan_licenses(docs).select(
        F.col("id").alias("doc_id"), "n_words", F.size("phrases").cast("long").alias("n_base"),
        F.array_min(first).alias("first_word"), F.array_max(first).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("phrases.label")), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score")


_PHRASES = [(t.label, t.markup) for t in PHRASES]
_TOKEN = re.compile(r"<<(beginOptional|endOptional|var)([^<>]*)>>|([a-z0-9]+)")


def _pattern(markup: str) -> tuple[int, str]:
    """Words that have to agree, and a regular expression over words between spaces."""
    pattern, count, depth = [], 0, 0
    for mark, rest, word in _TOKEN.findall(markup):
        if mark == "beginOptional":
            pattern.append("(?:")
            depth += 1
        elif mark == "endOptional":
            pattern.append(")?")
            depth -= 1
        elif mark == "var":
            match = rest.split('match="')[1].split('"')[0]
            if match.startswith("."):
                pattern.append("(?: [^ ]+ )" + match[1:])
            else:
                choices = [c.split() for c in match.split("|")]
                pattern.append("(?:" + "|".join("".join(f" {w} " for w in c) for c in choices) + ")")
                count += min(map(len, choices)) if not depth else 0
        else:
            pattern.append(f" {word} ")
            count += not depth
    return count, "".join(pattern)


def _oracle() -> str:
    def spaced(phrase):
        return "".join(f" {w} " for w in phrase.split())

    pieces, labels, scores = [], [], []
    for label, phrase in _PHRASES:
        has = f"contains(t, '{spaced(phrase)}')"
        pieces.append(f"""SELECT doc_id, '{label}' AS label, generate_subscripts(p, 1) AS k, p
            FROM (SELECT doc_id, string_split(t, '{spaced(phrase)}') AS p FROM spaced
                  WHERE {has})""")
        labels.append(f"CASE WHEN {has} THEN '{label}' END")
        scores.append(f"CASE WHEN {has} THEN {len(phrase.split())} ELSE 0 END")
    for label, (count, pattern) in ((t.label, _pattern(t.markup)) for t in NOTICES):
        has = f"regexp_matches(t, '{pattern}')"
        labels.append(f"CASE WHEN {has} THEN '{label}' END")
        scores.append(f"CASE WHEN {has} THEN {count} ELSE 0 END")
    sizes = " ".join(f"WHEN '{label}' THEN {len(p.split())}" for label, p in _PHRASES)
    return f"""
    WITH folded AS (
        SELECT doc_id, regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g') AS f
        FROM documents),
    spaced AS (
        SELECT doc_id, CASE WHEN trim(f, ' ') = '' THEN ''
            ELSE ' ' || replace(trim(f, ' '), ' ', '  ') || ' ' END AS t FROM folded),
    parts AS ({" UNION ALL ".join(pieces)}),
    places AS (
        SELECT doc_id, label,
            -- words before the place: those of the parts before it, and the phrases between
            list_sum([len(x) - len(replace(x, ' ', '')) for x in p[:k]]) // 2
                + (k - 1) * CASE label {sizes} END AS first_word
        FROM parts WHERE k < len(p)),
    base AS (
        SELECT doc_id, count(*) AS n_base, min(first_word)::BIGINT AS first_word,
            max(first_word)::BIGINT AS last_word,
            string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
        FROM places GROUP BY doc_id),
    scored AS (
        SELECT doc_id, ((len(t) - len(replace(t, ' ', ''))) // 2)::BIGINT AS n_words,
            array_to_string(list_sort(list_distinct([{", ".join(labels)}])), ',') AS labels,
            greatest({", ".join(scores)}) AS longest
        FROM spaced)
    SELECT s.doc_id, n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
        coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
        CASE WHEN longest = 0 THEN 0.0::DOUBLE ELSE 1 - pow(0.5::DOUBLE, longest) END AS score
    FROM scored s LEFT JOIN base b ON s.doc_id = b.doc_id"""


QUERIES = {"op1_license_scan": op1_license_scan}
ORACLES = {"op1_license_scan": _oracle()}
