"""Sources and sinks as queries: files are rendered from the tables and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caretlake.functions.tokens import tokens
from caretlake.operators import reports
from caretlake.operators import vocabulary as voc
from caretlake.plans import catalog as cat
from caretlake.operators.completers import make_completer
from caretlake.sources import dumps, logs, paged, text


def _line_files(spark, rows: DataFrame, name: str, order: str, **options) -> str:
    """Rows of one column `value` as text files whose names follow `order`."""
    path = cat._folder(spark, name)
    # Files of bounded size: their number follows the splits of the table.
    files = 4 * max(1, rows.rdd.getNumPartitions())
    parts = rows.repartitionByRange(files, order).sortWithinPartitions(order)
    parts.select("value").write.options(**options).text(path)
    return path


def _session_files(spark, sf, name: str) -> str:
    """A file of plain lines per conversation."""
    turns = cat.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ").alias("value"))
    path = cat._folder(spark, name)
    (turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn")
     .select("conv_id", "value").write.partitionBy("conv_id").text(path))
    return path


def vocab_source(spark, sf):
    """The lines of all documents as a vocabulary, in gzip files."""
    docs = cat.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("value"))
    return text.read_vocab(spark, _line_files(spark, docs, "lines", "doc_id", compression="gzip"))


def message_source(spark, sf):
    """A file of plain lines per conversation."""
    path = _session_files(spark, sf, "messages")
    return logs.read_messages(spark, path, "text").select("seq", "direction", "raw")


def message_stream(spark, sf):
    """The same files as a stream, numbered by the bytes their lines begin at."""
    path, out = _session_files(spark, sf, "growing"), cat._folder(spark, "streamed")
    stream = logs.stream_messages(spark, path, "lines")
    (stream.writeStream.format("parquet").option("checkpointLocation", cat._folder(spark, "state"))
     .trigger(availableNow=True).start(out).awaitTermination())
    return spark.read.schema(stream.schema).parquet(out).select("seq", "direction", "raw")


def paged_responses(spark, sf):
    """One request per language, answered with the whole vocabulary of all documents."""
    lang = F.coalesce("lang", F.lit(""))
    asked = cat.table(spark, sf, "documents").groupBy(lang.alias("lang")).agg(
        F.min("doc_id").alias("session"), F.count("*").alias("seq")).select(
        "session", "seq", F.concat(F.lit('"'), "lang", F.lit('"')).alias("id"),
        F.col("lang").alias("request_id"))
    path = cat._folder(spark, "paged")
    completer = make_completer("vocab", vocab=cat._vocab(spark, sf))
    paged.write_pages(completer.pages(asked), path)
    return paged.read_page_index(spark, path).select("session", "seq", "bytes", "items", "md5")


def timing_source(spark, sf):
    """Timings through a CSV file."""
    path = cat._folder(spark, "timings")
    cat._timings(spark, sf).select("measure", "text").write.option("header", True).csv(path)
    parsed = reports.parse_measure(logs.read_timings(spark, path))
    return parsed.select("mean", "std_published", F.round("std_ms", 9).alias("std_ms"), "text")


def server_log_source(spark, sf):
    """Log records with tracebacks; those of level error and above are kept."""
    e = F.col("event_id")
    level = F.element_at(F.array(*[F.lit(n) for n in cat.S.LOG_LEVELS]), (e % 5 + 1).cast("int"))
    head = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss,000 "),
                    level, F.lit(" "), F.col("event_type"))
    trace = F.when(e % 3 == 0, F.concat(F.lit("\nTraceback\n  event "), e.cast("string"))).otherwise("")
    rows = cat.table(spark, sf, "events").select("event_id", F.concat(head, trace).alias("value"))
    read = logs.read_server_log(spark, _line_files(spark, rows, "server", "event_id"), "error")
    return read.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "level", "message")


def corpus_text_source(spark, sf):
    """A file per passage."""
    path = cat._folder(spark, "passages")
    rows = cat.table(spark, sf, "benchmark").select("item_id", F.col("text").alias("value"))
    rows.write.partitionBy("item_id").text(path)
    return text.read_corpus(spark, path, "text").select(
        F.regexp_extract("uri", r"item_id=(\d+)", 1).cast("bigint").alias("item_id"), "text")


def corpus_xml_source(spark, sf):
    """Documents as pages of a wiki dump. Their white space is not kept by XML."""
    body = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\s\p{Cc}]+", " ")
    rows = cat.table(spark, sf, "documents").select(
        F.concat(F.lit("page "), F.col("doc_id")).alias("title"),
        F.struct(F.struct(F.trim(body).alias("_VALUE"), F.lit("preserve").alias("_space"))
                 .alias("text")).alias("revision"))
    path = cat._folder(spark, "dump")
    rows.write.format("xml").option("rowTag", "page").option("rootTag", "mediawiki").save(path)
    return text.read_corpus(spark, path, "xml").select(
        "uri", F.coalesce("text", F.lit("")).alias("text"))


def corpus_dump_source(spark, sf):
    """Documents as multistream dumps, read back stream by stream."""
    body = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\s\p{Cc}]+", " ")
    rows = cat.table(spark, sf, "documents").select(
        F.concat(F.lit("page "), F.col("doc_id")).alias("uri"), F.trim(body).alias("text"))
    streams = dumps.write_multistream(rows, cat._folder(spark, "multistream"))
    return dumps.read_multistream(streams).select("uri", F.coalesce("text", F.lit("")).alias("text"))


def response_sink(spark, sf):
    """Responses written as messages and read again: the words of every turn as labels."""
    words = cat._requests(spark, sf).select(
        F.lit(0).cast("bigint").alias("session"), F.col("request_id").alias("seq"),
        F.col("request_id").cast("string").alias("id"), tokens(F.col("text")).alias("labels"))
    path = cat._folder(spark, "responses")
    logs.write_responses(voc.completion_items(words), path)
    return logs.read_messages(spark, path).select("session", "seq", "direction", "raw")


QUERIES = {f.__name__: f for f in [
    vocab_source, message_source, message_stream, paged_responses, timing_source, server_log_source, corpus_text_source,
    corpus_xml_source, corpus_dump_source, response_sink]}


def oracles(timings: str, words: str) -> dict[str, str]:
    """`timings`: the CTE `timed`; `words`: the tokens of a column `text`."""
    return {
        "vocab_source": """
          WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
          r AS (SELECT doc_id, unnest(ls) AS item, unnest(range(1, len(ls) + 1)) AS i FROM l)
          SELECT row_number() OVER (ORDER BY doc_id, i) - 1 AS idx, item FROM r""",
        "message_source": """
          SELECT row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq, 'in' AS direction,
                 regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g') AS raw FROM conversations""",
        "message_stream": """
          SELECT CAST(coalesce(sum(strlen(raw) + 1) OVER (PARTITION BY conv_id ORDER BY turn
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS seq,
                 'in' AS direction, raw
          FROM (SELECT *, regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g') AS raw FROM conversations)""",
        "paged_responses": f"""
          WITH asked AS (SELECT coalesce(lang, '') AS lang, min(doc_id) AS session, count(*) AS seq
                         FROM documents GROUP BY 1),
          counted AS (SELECT item, count(*) AS n FROM (SELECT unnest({words}) AS item FROM documents) GROUP BY 1),
          listed AS (SELECT string_agg('{{"label":"' || item || '"}}', ',' ORDER BY n DESC, item) AS l,
                            count(*) AS items FROM counted),
          lines AS (SELECT session, seq, items, '{{"jsonrpc":"2.0","id":"' || lang || '","result":['
                           || l || ']}}' AS line FROM asked, listed)
          SELECT session, seq, strlen(line) AS bytes, items, md5(line) AS md5 FROM lines""",
        "timing_source": f"""WITH {timings}
          SELECT mean, std AS std_published, round(std * std_unit, 9) AS std_ms,
                 CASE event_type WHEN 'signup' THEN 'TF' WHEN 'error' THEN 'TF + JIT'
                   WHEN 'view' THEN 'PyTorch' WHEN 'click' THEN 'ONNX Default (11)'
                   ELSE 'ONNX oneDNN (12)' END AS text
          FROM timed JOIN events USING (event_id)""",
        "server_log_source": """
          WITH r AS (SELECT *, ['DEBUG', 'INFO', 'WARNING', 'ERROR', 'CRITICAL'][event_id % 5 + 1] AS lv
                     FROM events WHERE event_id % 5 >= 3)
          SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, lv AS level, event_type AS message FROM r
          UNION ALL SELECT NULL, NULL, 'Traceback' FROM r WHERE event_id % 3 = 0
          UNION ALL SELECT NULL, NULL, '  event ' || event_id FROM r WHERE event_id % 3 = 0""",
        "corpus_text_source": "SELECT item_id, text || chr(10) AS text FROM benchmark",
        "corpus_xml_source": """
          SELECT 'page ' || doc_id AS uri,
                 trim(regexp_replace(coalesce(text, ''), '[\\s\\p{Cc}]+', ' ', 'g')) AS text FROM documents""",
        "corpus_dump_source": """
          SELECT 'page ' || doc_id AS uri,
                 trim(regexp_replace(coalesce(text, ''), '[\\s\\p{Cc}]+', ' ', 'g')) AS text FROM documents""",
        "response_sink": f"""
          SELECT CAST(0 AS BIGINT) AS session, conv_id * 1000 + turn AS seq, 'out' AS direction,
                 '{{"jsonrpc":"2.0","id":' || (conv_id * 1000 + turn) || ',"result":['
                 || coalesce(array_to_string(['{{"label":"' || w || '"}}' for w in {words}], ','), '')
                 || ']}}' AS raw FROM conversations""",
    }
