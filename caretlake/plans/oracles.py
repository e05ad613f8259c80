"""The registered queries once more, as SQL over the same tables (DuckDB dialect)."""

from __future__ import annotations

from caretlake import schemas as S
from caretlake.plans.source_queries import oracles as source_oracles

_TOKENS = r"list_filter(string_split_regex({text}, '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def _tokens(text: str = "text") -> str:
    return _TOKENS.format(text=text)


# --- cursors -----------------------------------------------------------------------------

_CURSORS = """
cursors AS (
  SELECT doc_id AS request_id, CASE WHEN doc_id % 50 = 7 THEN -doc_id ELSE doc_id END AS uri,
         CAST(doc_id % 7 AS INTEGER) AS line, CAST(1 + doc_id % 60 AS INTEGER) AS ch
  FROM documents),
joined AS (
  SELECT c.*, d.text, string_split(d.text, chr(10)) AS ls
  FROM cursors c LEFT JOIN documents d ON d.doc_id = c.uri),
placed AS (
  SELECT *, CASE WHEN text IS NULL THEN 'unknown_document'
                 WHEN line >= len(ls) THEN 'no_such_line'
                 WHEN ch > length(ls[line + 1]) THEN 'past_eol' ELSE 'ok' END AS status
  FROM joined),
resolved AS (
  SELECT *, CASE WHEN status = 'ok' THEN CAST(coalesce(list_sum(
           list_transform(ls[1:line], lambda l: length(l) + 1)), 0) + ch AS INTEGER) END AS pos
  FROM placed),
cut AS (
  SELECT *, right(left(text, pos), 128) AS prefix, left(substring(text, pos + 2), 127) AS suffix
  FROM resolved)
"""

# --- n-grams -------------------------------------------------------------------------------

_MODEL = f"""
words AS (SELECT {_tokens()} AS w FROM documents),
grams AS (
  SELECT w[i] AS l, w[i + 1] AS t, w[i + 2] AS r
  FROM (SELECT w, unnest(range(1, len(w) - 1)) AS i FROM words)),
levels AS (
  SELECT 1 AS level, l || ' ' || r AS key, t AS token FROM grams
  UNION ALL SELECT 2, l, t FROM grams
  UNION ALL SELECT 3, '', t FROM grams),
counted AS (SELECT level, key, token, count(*) AS n FROM levels GROUP BY ALL),
model AS (
  SELECT level, key, token, n,
         CAST(row_number() OVER (PARTITION BY level, key ORDER BY n DESC, token) AS INTEGER) AS rk
  FROM counted QUALIFY rk <= 10)
"""

_PASSAGES = f"""
passages AS (SELECT item_id, {_tokens()} AS w FROM benchmark),
prompts AS (
  SELECT item_id * 1000000 + i AS request_id, w[i] AS l, w[i + 1] AS target, w[i + 2] AS r
  FROM (SELECT item_id, w, unnest(range(1, len(w) - 1)) AS i FROM passages))
"""

_RANKED = """
asked AS (
  SELECT request_id, 1 AS level, l || ' ' || r AS key FROM prompts WHERE l IS NOT NULL AND r IS NOT NULL
  UNION ALL SELECT request_id, 2, l FROM prompts WHERE l IS NOT NULL
  UNION ALL SELECT request_id, 3, '' FROM prompts),
found AS (
  SELECT request_id, token, level, n FROM asked JOIN model USING (level, key)
  QUALIFY row_number() OVER (PARTITION BY request_id, token ORDER BY level) = 1),
ranked AS (
  SELECT request_id, level, n, token AS label, CAST(row_number() OVER (
    PARTITION BY request_id ORDER BY level, n DESC, token) AS INTEGER) AS rank
  FROM found QUALIFY rank <= {k})
"""

_SCORES = """
  count(*) AS prompts, CAST(count(*) FILTER (hit = 1) AS BIGINT) AS hits_at_1,
  count(hit) AS hits_at_k, round(sum(coalesce(1.0 / hit, 0)) / count(*), 6) AS mrr,
  round(CAST(count(*) FILTER (answers > 0) AS DOUBLE) / count(*), 6) AS coverage
"""

# --- vocabulary ------------------------------------------------------------------------------

_COUNTED_WORDS = f"""
counted_words AS (
  SELECT item, count(*) AS n FROM (SELECT unnest({_tokens()}) AS item FROM documents) GROUP BY item)
"""


def _vocab(size: int | None = None, min_count: int = 1) -> str:
    limit = "" if size is None else f"QUALIFY idx < {size}"
    return f"""{_COUNTED_WORDS},
vocab AS (
  SELECT row_number() OVER (ORDER BY n DESC, item) - 1 AS idx, item, n
  FROM counted_words WHERE n >= {min_count} {limit})
"""


_REQUESTS = "requests AS (SELECT conv_id * 1000 + turn AS request_id, text FROM conversations)"

# --- session log -----------------------------------------------------------------------------

_LOG = """
firsts AS (SELECT conv_id, role, min(turn) AS f FROM conversations GROUP BY ALL),
turns AS (
  SELECT c.conv_id, c.turn, c.text, c.turn = f.f AS k,
         'conv://' || c.conv_id || '/' || c.role AS uri, 'conv://' || c.conv_id || '/user' AS user_uri
  FROM conversations c JOIN firsts f USING (conv_id, role)),
log AS (
  SELECT DISTINCT conv_id AS session, CAST(0 AS BIGINT) AS seq, 'initialize' AS method,
         CAST(NULL AS VARCHAR) AS uri, CAST(NULL AS VARCHAR) AS text, false AS ranged,
         CAST(NULL AS INTEGER) AS line, CAST(NULL AS INTEGER) AS ch, true AS req, false AS badid
  FROM conversations
  UNION ALL SELECT conv_id, 30, 'initialize', NULL, NULL, false, NULL, NULL, true, false
    FROM turns WHERE turn = 3 AND conv_id % 10 = 0
  UNION ALL SELECT conv_id, turn * 10 + 1, CASE WHEN k THEN 'textDocument/didOpen'
      ELSE 'textDocument/didChange' END, uri, text, NOT k AND (turn % 5 = 4 OR turn % 9 = 7), NULL, NULL, false, false
    FROM turns
  UNION ALL SELECT conv_id, turn * 10 + 2, 'textDocument/completion', user_uri, NULL, false, 0,
      CAST(1 + (conv_id + turn) % 40 AS INTEGER), true, false FROM turns
  UNION ALL SELECT conv_id, turn * 10 + 3, 'textDocument/hover', uri, NULL, false, NULL, NULL, true, false
    FROM turns WHERE turn = 1 AND conv_id % 7 = 3
  UNION ALL SELECT conv_id, turn * 10 + 4, 'foo/bar', NULL, NULL, false, NULL, NULL, true, false
    FROM turns WHERE turn = 1 AND conv_id % 11 = 5
  UNION ALL SELECT conv_id, turn * 10 + 5, 'textDocument/hover', uri, NULL, false, NULL, NULL, false, true
    FROM turns WHERE turn = 1 AND conv_id % 13 = 6
  UNION ALL SELECT conv_id, turn * 10 + 6, 'textDocument/didSave', uri, NULL, false, NULL, NULL, false, false
    FROM turns WHERE turn % 2 = 0
  UNION ALL SELECT conv_id, turn * 10 + 7, 'textDocument/didClose', uri, NULL, false, NULL, NULL, false, false
    FROM turns WHERE turn % 4 = 3)
"""

_EPOCHS = f"""{_LOG},
e AS (
  SELECT *, CAST(sum(CASE WHEN method = 'initialize' THEN 1 ELSE 0 END)
         OVER (PARTITION BY session ORDER BY seq) AS BIGINT) AS epoch
  FROM log),
opened AS (
  SELECT session, epoch, uri, min(seq) AS o FROM e WHERE method = 'textDocument/didOpen' GROUP BY ALL),
writes AS (
  SELECT e.* FROM e WHERE method = 'textDocument/didOpen'
    OR (method = 'textDocument/didChange' AND NOT ranged)),
live AS (
  SELECT w.* FROM writes w JOIN opened USING (session, epoch, uri) WHERE w.seq >= o)
"""

_AS_OF = f"""{_EPOCHS},
asof_rows AS (
  SELECT r.session, r.seq, r.epoch, r.uri, r.line, r.ch, w.seq AS write_seq, w.text,
         CASE WHEN w.seq IS NULL THEN 'unknown_document' ELSE 'ok' END AS status
  FROM (SELECT * FROM e WHERE method = 'textDocument/completion') r
  ASOF LEFT JOIN live w ON r.session = w.session AND r.epoch = w.epoch AND r.uri = w.uri
    AND r.seq > w.seq)
"""

# All completion cursors of the log sit in line 0.
_PROMPTS = f"""{_AS_OF},
prompted AS (
  SELECT *, CASE WHEN status <> 'ok' THEN status
                 WHEN ch > length(string_split(text, chr(10))[1]) THEN 'past_eol'
                 ELSE 'ok' END AS outcome
  FROM asof_rows),
prompt_rows AS (
  SELECT session, seq, uri, outcome AS status, CASE WHEN outcome = 'ok' THEN ch END AS pos,
         CASE WHEN outcome = 'ok' THEN right(left(text, ch), 128) || '<mask>'
           || left(substring(text, ch + 2), 127) END AS prompt,
         CASE WHEN outcome = 'ok' THEN right(left(text, ch), 128) END AS prefix,
         CASE WHEN outcome = 'ok' THEN left(substring(text, ch + 2), 127) END AS suffix
  FROM prompted)
"""

_STATUS = f"""{_PROMPTS},
isolated AS (
  SELECT e.session, e.seq, e.method, e.ch, CASE
      WHEN badid THEN 'bad_id'
      WHEN method = 'foo/bar' THEN 'method_not_found'
      WHEN method = 'textDocument/hover' THEN 'not_implemented'
      WHEN (method = 'textDocument/completion' OR (method = 'textDocument/didChange' AND NOT ranged))
        AND (o IS NULL OR o > e.seq) THEN 'unknown_document'
      ELSE 'ok' END AS status
  FROM e LEFT JOIN opened USING (session, epoch, uri)),
positioned AS (
  SELECT i.session, i.seq, i.method,
         CASE WHEN i.status = 'ok' THEN coalesce(p.status, 'ok') ELSE i.status END AS status
  FROM isolated i LEFT JOIN prompt_rows p USING (session, seq))
"""

_FATAL = ", ".join(f"'{s}'" for s in S.FATAL)

_ID = """CASE session % 4 WHEN 1 THEN '"r-' || seq % 40 || '"' WHEN 2 THEN '"' || seq % 40 || '"'
  WHEN 3 THEN CASE WHEN seq % 3 = 0 THEN 'true' ELSE CAST(seq % 40 AS VARCHAR) END
  ELSE CAST(seq % 40 AS VARCHAR) END"""

_TRAFFIC = f"""{_LOG},
both_ways AS (
  SELECT session, seq * 2 AS seq, 'in' AS direction,
         CASE WHEN badid THEN '1.5' WHEN req THEN {_ID} END AS id, method,
         req, badid, CAST(NULL AS INTEGER) AS code FROM log
  UNION ALL
  SELECT session, seq * 2 + 1, 'out',
         CASE WHEN badid THEN NULL ELSE {_ID} END, NULL, false, false,
         CASE WHEN method = 'foo/bar' THEN -32601 WHEN badid THEN -32600
              WHEN method = 'textDocument/hover' THEN -32603 END
  FROM log WHERE (req OR badid) AND session % 9 <> 4)
"""

_ROUTES = "routes(endpoint, reqres, implemented) AS (VALUES " + ", ".join(
    f"('{s + '/' if s else ''}{n}', {str(r).lower()}, {str(i).lower()})"
    for s, n, r, i in S.ROUTES) + ")"

_CODES = "codes(code, name, family) AS (VALUES " + ", ".join(
    f"({c}, '{n}', '{f}')" for c, n, f in S.ERROR_CODES) + ")"

# --- timings ---------------------------------------------------------------------------------

_TIMINGS = """
timed AS (
  SELECT event_id, CAST(ceil(value) AS INTEGER) AS mean,
         CASE WHEN event_id % 4 = 0 THEN 0.5 ELSE CAST(event_id % 100 AS DOUBLE) / 10 END AS std,
         CASE event_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.001 ELSE 1000.0 END AS std_unit,
         CASE event_type WHEN 'signup' THEN 'TensorFlow' WHEN 'error' THEN 'TensorFlow'
              WHEN 'view' THEN 'PyTorch' ELSE 'ONNX' END AS framework,
         CASE event_type WHEN 'signup' THEN 'Default' WHEN 'error' THEN 'w/ JIT'
              WHEN 'view' THEN 'Default' WHEN 'click' THEN 'Default (11)'
              ELSE 'oneDNN (12)' END AS label
  FROM events)
"""

_WINDOWS = """
SELECT strftime(time_bucket(INTERVAL 1 hour, ts), '%Y-%m-%d %H:%M:%S') AS window_start,
       event_type, count(*) AS n FROM events GROUP BY ALL
"""


def oracles() -> dict[str, str]:
    model, passages = f"WITH {_MODEL}", f"WITH {_MODEL}, {_PASSAGES}"
    ranked = f"{passages}, {_RANKED.format(k=10)}"
    scored = """, scored AS (
      SELECT p.request_id, min(CASE WHEN c.label = p.target THEN c.rank END) AS hit,
             count(c.rank) AS answers
      FROM prompts p LEFT JOIN ranked c USING (request_id) GROUP BY p.request_id)"""
    streamed = f"""WITH {_PROMPTS}, {_MODEL},
      sides AS (SELECT session, seq, session * 1000000 + seq AS request_id,
                       {_tokens('prefix')} AS lw, {_tokens('suffix')} AS rw
                FROM prompt_rows WHERE status = 'ok'),
      prompts AS (SELECT *, lw[len(lw)] AS l, rw[1] AS r FROM sides),
      {_RANKED.format(k=3)}
      SELECT session, seq, {_ID} AS id, 'out' AS direction, labels FROM (
        SELECT p.session, p.seq, string_agg(label, '|' ORDER BY rank) AS labels
        FROM prompts p JOIN ranked USING (request_id) GROUP BY ALL)"""
    prompt_list = f"WITH {_PROMPTS} SELECT session, seq, {_ID} AS id, uri, status, pos, prompt FROM prompt_rows"
    return {
        "line_index": """
          SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, ls[i] AS line,
                 CAST(coalesce(sum(length(ls[i]) + 1) OVER (PARTITION BY doc_id ORDER BY i
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start
          FROM (SELECT doc_id, string_split(text, chr(10)) AS ls,
                       unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)""",
        "attach_documents": """
          SELECT event_id, user_id * 3 AS uri, CAST(length(text) AS INTEGER) AS chars,
                 CASE WHEN doc_id IS NULL THEN 'unknown_document' ELSE 'ok' END AS status
          FROM events LEFT JOIN documents ON doc_id = user_id * 3""",
        "resolve_position": f"WITH {_CURSORS} SELECT request_id, uri, line, ch, pos, status FROM resolved",
        "context_window": f"WITH {_CURSORS} SELECT request_id, pos, prefix, suffix FROM cut",
        "mask_prompt": f"""WITH {_CURSORS}
          SELECT request_id, prefix || '<mask>' || suffix AS prompt,
                 CASE WHEN status = 'ok' AND (contains(prefix, '<mask>') OR contains(suffix, '<mask>'))
                      THEN 'ambiguous_mask' ELSE status END AS status FROM cut""",
        "cloze_chars": """
          WITH d AS (SELECT doc_id, text, CAST(unnest(range(0, 3)) AS INTEGER) AS i FROM documents
                     WHERE length(text) > 0),
          p AS (SELECT *, CAST((doc_id * 31 + i * 17) % length(text) AS INTEGER) AS pos FROM d)
          SELECT doc_id, i, pos, right(left(text, pos), 128) AS prefix,
                 left(substring(text, pos + 2), 127) AS suffix, substring(text, pos + 1, 1) AS target
          FROM p""",
        "cloze_words": f"""
          WITH d AS (SELECT doc_id, {_tokens()} AS w, CAST(unnest(range(0, 3)) AS INTEGER) AS i
                     FROM documents),
          p AS (SELECT *, CAST((doc_id * 31 + i * 17) % (len(w) - 2) + 1 AS INTEGER) AS pos
                FROM d WHERE len(w) > 2)
          SELECT doc_id, i, pos, array_to_string(w[1:pos], ' ') AS prefix,
                 array_to_string(w[pos + 2:], ' ') AS suffix, w[pos + 1] AS target FROM p""",
        "build_vocab": f"WITH {_vocab()} SELECT idx, item, n FROM vocab",
        "build_vocab_top": f"WITH {_vocab(1000, 2)} SELECT idx, item, n FROM vocab",
        "train_ngram": f"{model} SELECT level, key, token, n, rk FROM model",
        "train_ngram_two_words": f"""
          WITH words AS (SELECT {_tokens()} AS w FROM documents),
          grams AS (
            SELECT CASE WHEN i > 1 THEN w[i - 1] END AS ll, w[i] AS l, w[i + 1] AS t, w[i + 2] AS r
            FROM (SELECT w, unnest(range(1, len(w) - 1)) AS i FROM words)),
          levels AS (
            SELECT 1 AS level, l || ' ' || r AS key, t AS token FROM grams
            UNION ALL SELECT 2, ll || ' ' || l, t FROM grams WHERE ll IS NOT NULL
            UNION ALL SELECT 3, l, t FROM grams
            UNION ALL SELECT 4, '', t FROM grams)
          SELECT level, key, token, count(*) AS n, CAST(row_number() OVER (
            PARTITION BY level, key ORDER BY count(*) DESC, token) AS INTEGER) AS rk
          FROM levels GROUP BY level, key, token HAVING count(*) >= 2 QUALIFY rk <= 10""",
        "top_k": f"""
          SELECT lang, token, count(*) AS n, CAST(row_number() OVER (
            PARTITION BY lang ORDER BY count(*) DESC, token) AS INTEGER) AS rank
          FROM (SELECT lang, unnest({_tokens()}) AS token FROM documents)
          GROUP BY lang, token QUALIFY rank <= 10""",
        "ngram_complete": f"{ranked} SELECT request_id, rank, label, level, n FROM ranked",
        "evaluate_completion": f"{ranked}{scored} SELECT {_SCORES} FROM scored",
        "evaluate_predictions":
            f"{passages}, {_RANKED.format(k=5)}{scored} SELECT {_SCORES} FROM scored",
        "evaluate_by_language": f"""
          WITH words AS (SELECT doc_id % 2 AS fold, lang, {_tokens()} AS w FROM documents),
          grams AS (
            SELECT fold, lang, w[i] AS l, w[i + 1] AS t, w[i + 2] AS r
            FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM words)),
          levels AS (
            SELECT 1 - fold AS fold, 1 AS level, l || ' ' || r AS key, t AS token FROM grams
            UNION ALL SELECT 1 - fold, 2, l, t FROM grams
            UNION ALL SELECT 1 - fold, 3, '', t FROM grams),
          model AS (
            SELECT fold, level, key, token, count(*) AS n, row_number() OVER (
              PARTITION BY fold, level, key ORDER BY count(*) DESC, token) AS rk
            FROM levels GROUP BY fold, level, key, token QUALIFY rk <= 10),
          prompts AS (
            SELECT row_number() OVER () AS request_id, fold, lang, l, r, t AS target, count(*) AS weight
            FROM grams GROUP BY fold, lang, l, r, t),
          asked AS (
            SELECT request_id, fold, 1 AS level, l || ' ' || r AS key FROM prompts
            UNION ALL SELECT request_id, fold, 2, l FROM prompts
            UNION ALL SELECT request_id, fold, 3, '' FROM prompts),
          found AS (
            SELECT request_id, token, level, n FROM asked JOIN model USING (fold, level, key)
            QUALIFY row_number() OVER (PARTITION BY request_id, token ORDER BY level) = 1),
          ranked AS (
            SELECT request_id, token, row_number() OVER (
              PARTITION BY request_id ORDER BY level, n DESC, token) AS rank
            FROM found QUALIFY rank <= 10),
          scored AS (
            SELECT p.request_id, lang, weight, min(CASE WHEN token = target THEN rank END) AS hit,
                   count(rank) AS answers
            FROM prompts p LEFT JOIN ranked USING (request_id) GROUP BY ALL)
          SELECT lang, CAST(sum(weight) AS BIGINT) AS prompts,
            CAST(coalesce(sum(weight) FILTER (hit = 1), 0) AS BIGINT) AS hits_at_1,
            CAST(coalesce(sum(weight) FILTER (hit IS NOT NULL), 0) AS BIGINT) AS hits_at_k,
            round(sum(coalesce(1.0 / hit, 0) * weight) / sum(weight), 6) AS mrr,
            round(CAST(coalesce(sum(weight) FILTER (answers > 0), 0) AS DOUBLE) / sum(weight), 6) AS coverage
          FROM scored GROUP BY lang""",
        "cloze_places": f"""
          SELECT doc_id, lang, CAST(i AS INTEGER) AS pos, w[i + 1] AS target
          FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i
                FROM (SELECT doc_id, lang, {_tokens()} AS w FROM documents))""",
        "cut_contexts": f"""
          SELECT item_id, CAST(i AS INTEGER) AS pos, w[i + 1] AS target,
                 array_to_string(w[greatest(i - 2, 1):i], ' ') AS prefix,
                 array_to_string(w[i + 2:i + 4], ' ') AS suffix
          FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i
                FROM (SELECT item_id, {_tokens()} AS w FROM benchmark))""",
        "evaluate_by_level": f"""{ranked}
          SELECT level, count(*) AS hits, CAST(count(*) FILTER (rank = 1) AS BIGINT) AS hits_at_1
          FROM ranked JOIN prompts USING (request_id) WHERE label = target GROUP BY level""",
        "vocab_complete": f"""WITH {_vocab()}, {_REQUESTS},
          pages AS (SELECT CAST(idx // 4096 AS INTEGER) AS page, CAST(count(*) AS INTEGER) AS n_labels,
                           arg_min(item, idx) AS first_label, arg_max(item, idx) AS last_label
                    FROM vocab GROUP BY 1)
          SELECT request_id, page, n_labels, first_label, last_label FROM requests, pages""",
        "vocab_completer": f"""WITH {_vocab()}, {_REQUESTS},
          pages AS (SELECT idx // 4096 AS page, count(*) AS n, md5(string_agg(item, '|' ORDER BY idx)) AS d
                    FROM vocab GROUP BY 1),
          whole AS (SELECT CAST(sum(n) AS BIGINT) AS n_labels,
                           md5(string_agg(d, '' ORDER BY page)) AS labels_md5 FROM pages)
          SELECT request_id, n_labels, labels_md5 FROM requests, whole""",
        "empty_complete": f"WITH {_REQUESTS} SELECT request_id, CAST(0 AS INTEGER) AS n_labels FROM requests",
        "limit_items": f"""WITH {_REQUESTS}
          SELECT request_id, array_to_string({_tokens()}[1:3], '|') AS labels FROM requests""",
        "completion_items": f"""{passages}, {_RANKED.format(k=3)}
          SELECT request_id, '[' || string_agg('{{"label":"' || label || '"}}', ',' ORDER BY rank)
                 || ']' AS items FROM ranked GROUP BY request_id""",
        "response_rows": f"""WITH {_REQUESTS},
          w AS (SELECT request_id, {_tokens()} AS w, coalesce(len(w), 0) = 0 AS is_null FROM requests)
          SELECT request_id, CAST(request_id AS VARCHAR) AS id, w[1] AS first_label,
                 CAST(CASE WHEN is_null THEN -1 ELSE len(w) END AS INTEGER) AS n_items,
                 is_null FROM w""",
        "encode_batches": f"""WITH {_vocab()},
          d AS (SELECT doc_id, doc_id // 32 AS batch, {_tokens()}[1:510] AS w FROM documents),
          longest AS (SELECT batch, max(len(w)) AS m FROM d GROUP BY batch),
          t AS (SELECT doc_id, unnest(w) AS item, unnest(range(1, len(w) + 1)) AS pos FROM d),
          c AS (SELECT doc_id, string_agg(CAST(coalesce(idx + 5, 1) AS VARCHAR), ' ' ORDER BY pos) AS ids
                FROM t LEFT JOIN vocab USING (item) GROUP BY doc_id)
          SELECT d.doc_id, d.batch, '2 ' || coalesce(ids || ' ', '') || '3' || repeat(' 0', m - len(w)) AS input_ids,
                 repeat('1', len(w) + 2) || repeat('0', m - len(w)) AS attention_mask
          FROM d JOIN longest USING (batch) LEFT JOIN c USING (doc_id)""",
        "model_complete": f"""WITH {_CURSORS},
          t AS (SELECT request_id, unnest(list_concat({_tokens('prefix')}, {_tokens('suffix')})) AS label
                FROM cut WHERE status = 'ok')
          SELECT request_id, label, CAST(count(*) AS DOUBLE) AS score, CAST(row_number() OVER (
            PARTITION BY request_id ORDER BY count(*) DESC, label) AS INTEGER) AS rank
          FROM t GROUP BY request_id, label QUALIFY rank <= 5""",
        "corpus_source": "SELECT CAST(page_id AS VARCHAR) AS uri, html AS text FROM pages",
        "session_epochs": f"WITH {_EPOCHS} SELECT session, seq, method, epoch FROM e WHERE NOT badid "
                          "UNION ALL SELECT session, seq, method, epoch FROM e WHERE badid",
        "effective_writes": f"""WITH {_EPOCHS}
          SELECT session, epoch, uri, seq, CAST(0 AS INTEGER) AS change_idx, text FROM writes""",
        "ignored_changes": f"""WITH {_EPOCHS}
          SELECT session, epoch, uri, seq, CAST(0 AS INTEGER) AS change_idx, text FROM e WHERE ranged""",
        "corpus_snapshot": f"""WITH {_EPOCHS},
          final AS (SELECT session, max(epoch) AS epoch FROM e GROUP BY session)
          SELECT session, epoch, uri, max(seq) AS seq, arg_max(text, seq) AS text
          FROM live JOIN final USING (session, epoch) GROUP BY session, epoch, uri""",
        "corpus_stats": f"""WITH {_EPOCHS},
          s AS (SELECT session, epoch, uri, arg_max(text, seq) AS text FROM live GROUP BY ALL)
          SELECT session, epoch, count(*) AS nodocs, CAST(sum(length(text)) AS BIGINT) AS chars
          FROM s GROUP BY ALL""",
        "corpus_as_of": f"""WITH {_AS_OF}
          SELECT session, seq, epoch, uri, status, write_seq, text FROM asof_rows""",
        "completion_prompts": prompt_list,
        "change_audit": f"""WITH {_EPOCHS},
          m AS (SELECT e.session, e.uri, e.method, e.ranged, coalesce(o <= e.seq, false) AS is_open
                FROM e LEFT JOIN opened USING (session, epoch, uri)
                WHERE NOT badid AND method IN ('textDocument/didOpen', 'textDocument/didChange',
                  'textDocument/didClose', 'textDocument/didSave'))
          SELECT session, uri,
            count(*) FILTER (method = 'textDocument/didChange' AND NOT ranged AND is_open) AS applied,
            count(*) FILTER (ranged) AS ignored,
            count(*) FILTER (method = 'textDocument/didOpen') AS opens,
            count(*) FILTER (method = 'textDocument/didClose') AS closes,
            count(*) FILTER (method = 'textDocument/didSave') AS saves
          FROM m GROUP BY session, uri""",
        "replay_status": f"WITH {_STATUS} SELECT session, seq, method, status FROM isolated",
        "fail_stop": f"""WITH {_STATUS},
          f AS (SELECT session, min(seq) AS first FROM positioned WHERE status IN ({_FATAL}) GROUP BY 1)
          SELECT session, seq, method, CASE WHEN seq > first THEN 'dropped' ELSE status END AS status
          FROM positioned LEFT JOIN f USING (session)""",
        "parse_envelope": f"""WITH {_TRAFFIC}
          SELECT session, seq, id, method, true AS version_ok,
            CASE WHEN badid THEN 'invalid' WHEN direction = 'out' THEN 'response'
                 WHEN req THEN 'request' ELSE 'notification' END AS kind,
            CASE WHEN badid THEN 'bad_id' ELSE 'ok' END AS status FROM both_ways""",
        "dead_letters": f"WITH {_LOG} SELECT session, seq, method, 'bad_id' AS reason FROM log WHERE badid",
        "route_messages": f"""WITH {_LOG}, {_ROUTES}
          SELECT session, seq, method, CASE WHEN endpoint IS NULL THEN 'method_not_found'
                   WHEN NOT implemented THEN 'not_implemented' ELSE 'ok' END AS route_status,
                 req <> reqres AS kind_mismatch
          FROM log LEFT JOIN routes ON endpoint = method""",
        "unknown_methods": f"""WITH {_LOG}, {_ROUTES}
          SELECT session, seq, method FROM log WHERE method NOT IN (SELECT endpoint FROM routes)""",
        "pair_messages": f"""WITH {_TRAFFIC},
          q AS (SELECT session, id, seq, row_number() OVER (PARTITION BY session, id ORDER BY seq) AS nth
                FROM both_ways WHERE req),
          r AS (SELECT session, id, seq, row_number() OVER (PARTITION BY session, id ORDER BY seq) AS nth
                FROM both_ways WHERE direction = 'out' AND id IS NOT NULL)
          SELECT coalesce(q.session, r.session) AS session, coalesce(q.id, r.id) AS id,
                 coalesce(q.nth, r.nth) AS nth, q.seq AS request_seq, r.seq AS response_seq,
                 r.seq - q.seq AS distance, CASE WHEN r.seq IS NULL THEN 'unanswered'
                   WHEN q.seq IS NULL THEN 'orphan' ELSE 'answered' END AS outcome
          FROM q FULL OUTER JOIN r ON q.session = r.session AND q.id = r.id AND q.nth = r.nth
            AND r.seq > q.seq""",
        "assign_request_ids": f"""WITH {_LOG}
          SELECT session, seq, method, row_number() OVER (PARTITION BY session ORDER BY seq) - 1 AS id
          FROM log WHERE req""",
        "session_profile": f"""WITH {_LOG}
          SELECT session, seq, CASE session % 5 WHEN 2 THEN session + 1000 WHEN 4 THEN 0 END AS pid,
            CASE WHEN session % 5 IN (0, 1) THEN 'absent' WHEN session % 5 = 3 THEN 'invalid_params'
                 ELSE 'ok' END AS pid_status,
            CASE session % 3 WHEN 0 THEN 'editor/1.' || session % 10 WHEN 1 THEN 'editor' END AS client,
            CASE WHEN session % 2 = 0 THEN 'en' ELSE '' END AS locale,
            CASE session % 4 WHEN 0 THEN '/w/' || session WHEN 1 THEN NULL
                 ELSE 'file:///w/' || session END AS root,
            CAST(session % 3 AS INTEGER) AS n_folders,
            CASE session % 3 WHEN 0 THEN '' WHEN 1 THEN 'n1 -> u1' ELSE 'n1 -> u1; n2 -> u2' END AS folders,
            CASE WHEN session % 6 = 0 THEN '{{"depth":' || session % 7 || '}}' END AS options,
            CASE WHEN session % 4 = 3 THEN 'verbose' ELSE 'off' END AS trace,
            session % 2 = 0 AS has_general, session % 2 = 0 AS has_document,
            false AS has_workspace, false AS has_experimental,
            CASE WHEN session % 2 = 0 THEN '{{}}' END AS general,
            CASE WHEN session % 2 = 0 THEN '{{"completion":true}}' END AS document,
            CAST(NULL AS VARCHAR) AS workspace, CAST(NULL AS VARCHAR) AS experimental
          FROM log WHERE method = 'initialize'""",
        "explain_errors": f"""WITH {_TRAFFIC}, {_CODES}
          SELECT session, seq, code, name, family, 'failed' AS message
          FROM both_ways JOIN codes USING (code)""",
        "traffic_summary": f"""WITH {_STATUS}
          SELECT session, method, status, count(*) AS messages,
                 CAST(grouping(session, method, status) AS INTEGER) AS grouping
          FROM isolated GROUP BY ROLLUP (session, method, status)""",
        "audit_frames": """
          WITH f AS (
            SELECT doc_id, text, doc_id % 8 AS h, doc_id % 11 = 3 AS broken,
                   octet_length(encode('{"id":' || doc_id || ',"t":' || to_json(text) || '}')) AS actual
            FROM documents),
          g AS (SELECT *, CASE WHEN doc_id % 13 = 1 THEN actual + 5 WHEN doc_id % 13 = 2 THEN actual - 1
                            WHEN doc_id % 13 = 3 THEN NULL ELSE actual END AS declared FROM f)
          SELECT doc_id, CASE WHEN h IN (0, 6) THEN 'application/vscode-jsonrpc'
                   WHEN h = 1 THEN 'text/plain' ELSE 'a/b' END AS mediatype,
            CASE h WHEN 3 THEN 'latin-1' WHEN 5 THEN 'us-ascii' WHEN 7 THEN 'koi8-r' ELSE 'utf-8' END AS charset,
            declared AS content_length, CAST(actual AS INTEGER) AS actual_length,
            CASE WHEN doc_id % 13 = 3 THEN 'missing_length' WHEN doc_id % 13 = 1 THEN 'short_body'
                 WHEN doc_id % 13 = 2 THEN 'long_body'
                 WHEN h = 5 AND octet_length(encode(text)) <> length(text) THEN 'undecodable'
                 WHEN broken THEN 'invalid_json' ELSE 'ok' END AS status
          FROM g""",
        "audit_charsets": """
          WITH f AS (
            SELECT doc_id, doc_id % 6 AS h, doc_id % 11 = 3 AS broken, doc_id % 13 = 5 AS cut,
                   '{"id":' || doc_id || ',"t":' || to_json(coalesce(text, '')) || '}' AS body
            FROM documents),
          g AS (
            SELECT *, CASE WHEN h <= 1 THEN 2 * length(body)
                             + 2 * length(regexp_replace(body, '[^\\x{10000}-\\x{10FFFF}]', '', 'g'))
                           WHEN h = 2 THEN 4 * length(body) ELSE octet_length(encode(body)) END AS size
            FROM f)
          SELECT doc_id, CASE h WHEN 0 THEN 'utf-16-be' WHEN 1 THEN 'utf-16-le' WHEN 2 THEN 'utf_32_be'
                   WHEN 3 THEN 'koi8-r' WHEN 4 THEN 'cp1252' ELSE 'x-none' END AS charset,
            CAST(size - CAST(cut AS INTEGER) AS INTEGER) AS actual_length,
            CASE WHEN h = 5 THEN 'unsupported_charset' WHEN h <= 2 AND cut THEN 'undecodable'
                 WHEN h = 4 AND regexp_matches(hex(encode(body)), '^(..)*(81|8D|8F|90|9D)') THEN 'undecodable'
                 WHEN broken OR cut THEN 'invalid_json' ELSE 'ok' END AS status
          FROM g""",
        "parse_measure": f"""WITH {_TIMINGS}
          SELECT event_id, mean, std AS std_published, round(std * std_unit, 9) AS std_ms FROM timed""",
        "label_timings": f"WITH {_TIMINGS} SELECT event_id, framework, label FROM timed",
        "timing_summary": f"""WITH {_TIMINGS}
          SELECT framework, count(*) AS n, CAST(min(mean) AS DOUBLE) AS min_ms,
                 round(avg(mean), 6) AS avg_ms, CAST(max(mean) AS DOUBLE) AS max_ms,
                 (SELECT label FROM timed b WHERE b.framework = t.framework ORDER BY mean, label LIMIT 1)
                   AS best_label,
                 round(min(mean) / 33.0, 6) AS to_target, round(min(mean) / 100.0, 6) AS to_limit
          FROM timed t GROUP BY framework""",
        "traffic_window": _WINDOWS,
        "stream_replay": prompt_list,
        "stream_handover": prompt_list,
        "stream_responses": streamed,
        "stream_windows": _WINDOWS,
        **source_oracles(_TIMINGS, _tokens()),
    }
