"""A JSON-RPC message log rendered from the `conversations` table.

Every conversation becomes an editor session: turns open and change documents, ask for
completions, and now and then send something a server cannot handle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_INIT_PARAMS = """
  concat('{',
    CASE conv_id % 5 WHEN 0 THEN '"processId":null,' WHEN 1 THEN ''
      WHEN 2 THEN concat('"processId":', conv_id + 1000, ',')
      WHEN 3 THEN '"processId":"x",' ELSE '"processId":0,' END,
    CASE conv_id % 3 WHEN 0 THEN concat('"clientInfo":{"name":"editor","version":"1.', conv_id % 10, '"},')
      WHEN 1 THEN '"clientInfo":{"name":"editor"},' ELSE '' END,
    IF(conv_id % 2 = 0, '"locale":"en",', ''),
    CASE conv_id % 4 WHEN 0 THEN '' WHEN 1 THEN '"rootUri":null,'
      ELSE concat('"rootUri":"file:///w/', conv_id, '",') END,
    CASE conv_id % 3 WHEN 0 THEN '' WHEN 1 THEN '"WorkspaceFolder":[{"uri":"u1","name":"n1"}],'
      ELSE '"WorkspaceFolder":[{"uri":"u1","name":"n1"},{"uri":"u2","name":"n2"}],' END,
    IF(conv_id % 6 = 0, concat('"initializationOptions":{"depth":', conv_id % 7, '},'), ''),
    IF(conv_id % 4 = 3, '"trace":"verbose",', ''),
    IF(conv_id % 2 = 0, '"capabilities":{"general":{},"textDocument":{"completion":true},"workspace":null},', ''),
    '"rootPath":"/w/', conv_id, '"}')
"""

# (offset in the turn, method, condition, is a request)
_TURN_MESSAGES = """
  array_compact(array(
    IF(turn = 3 AND conv_id % 10 = 0, named_struct('at', 0, 'method', 'initialize', 'req', true), NULL),
    named_struct('at', 1, 'method',
      IF(first, 'textDocument/didOpen', 'textDocument/didChange'), 'req', false),
    named_struct('at', 2, 'method', 'textDocument/completion', 'req', true),
    IF(turn = 1 AND conv_id % 7 = 3, named_struct('at', 3, 'method', 'textDocument/hover', 'req', true), NULL),
    IF(turn = 1 AND conv_id % 11 = 5, named_struct('at', 4, 'method', 'foo/bar', 'req', true), NULL),
    IF(turn = 1 AND conv_id % 13 = 6, named_struct('at', 5, 'method', 'textDocument/hover', 'req', true), NULL),
    IF(turn % 2 = 0, named_struct('at', 6, 'method', 'textDocument/didSave', 'req', false), NULL),
    IF(turn % 4 = 3, named_struct('at', 7, 'method', 'textDocument/didClose', 'req', false), NULL)))
"""

_PARAMS = """
  CASE method
    WHEN 'initialize' THEN {init}
    WHEN 'textDocument/didOpen' THEN to_json(named_struct(
      'textDocument', named_struct('uri', uri, 'text', text)))
    WHEN 'textDocument/didChange' THEN CASE
      WHEN turn % 5 <> 4 AND turn % 9 = 7 THEN to_json(named_struct(
        'textDocument', named_struct('uri', uri, 'version', turn),
        'contentChanges', array(named_struct('range', '0', 'text', text))))
      WHEN turn % 5 <> 4 AND turn % 6 = 5 THEN to_json(named_struct(
        'textDocument', named_struct('uri', uri, 'version', CAST(NULL AS INT)),
        'contentChanges', array(named_struct('range', CAST(NULL AS STRING), 'text', text))),
        map('ignoreNullFields', 'false'))
      ELSE to_json(named_struct(
        'textDocument', named_struct('uri', uri, 'version', turn),
        'contentChanges', array(named_struct('range', IF(turn % 5 = 4, named_struct(
          'start', named_struct('line', 0, 'character', 0)), NULL), 'text', text)))) END
    WHEN 'textDocument/completion' THEN to_json(named_struct(
      'textDocument', named_struct('uri', concat('conv://', conv_id, '/user')),
      'position', named_struct('line', 0, 'character', 1 + (conv_id + turn) % 40)))
    WHEN 'foo/bar' THEN '{{}}'
    ELSE to_json(named_struct('textDocument', named_struct('uri', uri)))
  END
"""


# Ids repeat within long sessions. They are numbers, strings that may look like numbers, or
# booleans; one kind of message carries an id of a wrong type.
_ID = """
  CASE WHEN at = 5 THEN '1.5' WHEN req THEN CASE conv_id % 4
    WHEN 1 THEN concat('"r-', seq % 40, '"') WHEN 2 THEN concat('"', seq % 40, '"')
    WHEN 3 THEN IF(seq % 3 = 0, 'true', CAST(seq % 40 AS STRING))
    ELSE CAST(seq % 40 AS STRING) END END
"""


def _inbound(conversations: DataFrame) -> DataFrame:
    firsts = conversations.groupBy("conv_id", "role").agg(F.min("turn").alias("_first"))
    turns = conversations.join(firsts, ["conv_id", "role"]).withColumn(
        "first", F.col("turn") == F.col("_first"))
    turns = turns.select(
        "conv_id", "turn", F.concat(F.lit("conv://"), "conv_id", F.lit("/"), "role").alias("uri"),
        "text", F.explode(F.expr(_TURN_MESSAGES)).alias("m"))
    turns = turns.select("conv_id", "turn", "uri", "text", (F.col("turn") * 10 + F.col("m.at")).alias("seq"),
                         F.col("m.at").alias("at"), F.col("m.method").alias("method"),
                         F.col("m.req").alias("req"))
    null = F.lit(None).cast("string")
    inits = conversations.select("conv_id").distinct().select(
        "conv_id", F.lit(0).cast("long").alias("turn"), null.alias("uri"), null.alias("text"),
        F.lit(0).cast("long").alias("seq"), F.lit(0).alias("at"),
        F.lit("initialize").alias("method"), F.lit(True).alias("req"))
    rows = turns.unionByName(inits)
    params = F.expr(_PARAMS.format(init=_INIT_PARAMS))
    return rows.withColumns({"params": params, "id": F.expr(_ID)})


def _raw():
    return F.concat(
        F.lit('{"jsonrpc":"2.0",'),
        F.coalesce(F.concat(F.lit('"id":'), "id", F.lit(",")), F.lit("")),
        F.lit('"method":"'), "method", F.lit('","params":'), "params", F.lit("}"))


def session_messages(conversations: DataFrame) -> DataFrame:
    """Inbound messages only: (session, seq, direction, raw)."""
    return _inbound(conversations).select(
        F.col("conv_id").alias("session"), "seq", F.lit("in").alias("direction"),
        _raw().alias("raw"))


def session_traffic(conversations: DataFrame) -> DataFrame:
    """Both directions. Inbound numbers are doubled; a response follows its request.

    Sessions with `conv_id % 9 = 4` stay unanswered; failures are answered with errors.
    """
    rows = _inbound(conversations)
    code = F.when(F.col("method") == "foo/bar", -32601).when(F.col("at") == 5, -32600).when(
        F.col("at") == 3, -32603)
    error = F.concat(F.lit(',"error":{"code":'), code, F.lit(',"message":"failed"}}'))
    reply = F.when(F.col("id").isNotNull() & (F.col("conv_id") % 9 != 4), F.concat(
        F.lit('{"jsonrpc":"2.0","id":'), F.when(F.col("at") == 5, "null").otherwise(F.col("id")),
        F.coalesce(error, F.lit(',"result":null}'))))
    both = F.array_compact(F.array(
        F.struct(F.lit(0).alias("k"), F.lit("in").alias("direction"), _raw().alias("raw")),
        F.when(reply.isNotNull(), F.struct(
            F.lit(1).alias("k"), F.lit("out").alias("direction"), reply.alias("raw")))))
    return rows.select(F.col("conv_id").alias("session"), "seq", F.explode(both).alias("b")).select(
        "session", (F.col("seq") * 2 + F.col("b.k")).alias("seq"),
        F.col("b.direction").alias("direction"), F.col("b.raw").alias("raw"))
