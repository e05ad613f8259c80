"""Row schemas, status vocabulary and the small fixed dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# --- row schemas -----------------------------------------------------------------

MESSAGES = T.StructType([
    T.StructField("session", T.LongType()),
    T.StructField("seq", T.LongType()),
    T.StructField("direction", T.StringType()),
    T.StructField("raw", T.StringType()),
])

TIMINGS = T.StructType([
    T.StructField("measure", T.StringType()),
    T.StructField("text", T.StringType()),
])

COMPLETIONS = T.StructType([
    T.StructField("request_id", T.LongType()),
    T.StructField("rank", T.IntegerType()),
    T.StructField("label", T.StringType()),
    T.StructField("score", T.DoubleType()),
])

# The part of a message the replay reads. VARIANT fields tell missing (NULL) from null, and a
# range from a string that only looks like one.
CALL_BODY = T.StructType([
    T.StructField("params", T.StructType([
        T.StructField("textDocument", T.StructType([
            T.StructField("uri", T.StringType()),
            T.StructField("text", T.StringType()),
            T.StructField("version", T.VariantType()),
        ])),
        T.StructField("position", T.StructType([
            T.StructField("line", T.IntegerType()),
            T.StructField("character", T.IntegerType()),
        ])),
        T.StructField("contentChanges", T.ArrayType(T.StructType([
            T.StructField("range", T.VariantType()),
            T.StructField("text", T.StringType()),
        ]))),
    ])),
])

# The same places with their types.
CALL_TYPES = T.StructType([
    T.StructField("params", T.StructType([
        T.StructField("textDocument", T.StructType([
            T.StructField("uri", T.VariantType()),
            T.StructField("text", T.VariantType()),
        ])),
        T.StructField("contentChanges", T.ArrayType(T.StructType([
            T.StructField("text", T.VariantType()),
        ]))),
    ])),
])

# --- status vocabulary -----------------------------------------------------------

OK = "ok"
PAST_EOL = "past_eol"
NO_SUCH_LINE = "no_such_line"
INVALID_POSITION = "invalid_position"
AMBIGUOUS_MASK = "ambiguous_mask"
UNKNOWN_DOCUMENT = "unknown_document"
NOT_INITIALIZED = "not_initialized"
METHOD_NOT_FOUND = "method_not_found"
NOT_IMPLEMENTED = "not_implemented"
INVALID_PARAMS = "invalid_params"
NOTIFICATION = "notification"

INVALID_ENVELOPE = "invalid_envelope"
NO_METHOD = "no_method"
METHOD_NOT_STRING = "method_not_string"
BAD_ID = "bad_id"

DROPPED = "dropped"
OUT_OF_ORDER = "out_of_order"

POSITION_ERRORS = (PAST_EOL, NO_SUCH_LINE, INVALID_POSITION)

# A message with one of these statuses ends its session under the fail-stop policy.
FATAL = (
    INVALID_ENVELOPE, METHOD_NOT_FOUND, NOT_IMPLEMENTED, INVALID_PARAMS,
    NOT_INITIALIZED, UNKNOWN_DOCUMENT, *POSITION_ERRORS, AMBIGUOUS_MASK,
)

# --- fixed values ----------------------------------------------------------------
# Endpoint table: (scope, name, takes a response, implemented).

ROUTES = [
    ("", "initialize", True, True),
    ("", "shutdown", True, True),
    ("", "initialized", False, True),
    ("", "exit", False, True),
    ("", "logTrace", False, False),
    ("", "setTrace", False, False),
    ("client", "registerCapability", True, False),
    ("client", "unregisterCapability", True, False),
    ("diagnostics", "publishDiagnostics", False, False),
    ("telemetry", "event", False, False),
    ("textDocument", "completion", True, True),
    ("textDocument", "hover", True, False),
    ("textDocument", "didChange", False, True),
    ("textDocument", "didClose", False, True),
    ("textDocument", "didOpen", False, True),
    ("textDocument", "didSave", False, True),
    ("textDocument", "willSave", False, False),
    ("textDocument", "willSaveWaitUntil", False, False),
    ("window", "showDocument", True, False),
    ("window", "showMessageRequest", True, False),
    ("window", "logMessage", False, False),
    ("window", "showMessage", False, False),
    ("workspace", "applyEdit", True, False),
    ("workspace", "configuration", True, False),
    ("workspace", "executeCommand", True, False),
    ("workspace", "symbol", True, False),
    ("workspace", "workspaceFolders", True, False),
    ("workspace", "didChangeConfiguration", False, False),
    ("workspace", "didChangeWatchedFiles", False, False),
    ("workspace", "didChangeWorkspaceFolders", False, False),
    ("workspace", "didCreateFiles", False, False),
    ("workspace", "didDeleteFiles", False, False),
    ("workspace", "didRenameFiles", False, False),
    ("workspace", "willCreateFiles", False, False),
    ("workspace", "willRenameFiles", False, False),
    ("workspace", "willDeleteFiles", False, False),
]

# JSON-RPC and language-server error codes.
ERROR_CODES = [
    (-32700, "ParseError", "json-rpc"),
    (-32600, "InvalidRequest", "json-rpc"),
    (-32601, "MethodNotFound", "json-rpc"),
    (-32602, "InvalidParams", "json-rpc"),
    (-32603, "InternalError", "json-rpc"),
    (-32099, "ServerErrorStart", "server"),
    (-32002, "ServerNotInitialized", "server"),
    (-32001, "UnknownErrorCode", "server"),
    (-32802, "ServerCancelled", "lsp"),
    (-32801, "ContentModified", "lsp"),
    (-32800, "RequestCancelled", "lsp"),
]

# Codes in this closed range belong to the server even without a name of their own.
SERVER_ERROR_RANGE = (-32099, -32000)

# Log level names by severity; "WARNING" is what the "warn" option lets through.
LOG_LEVELS = {"DEBUG": 10, "INFO": 20, "WARNING": 30, "ERROR": 40, "CRITICAL": 50}
LOG_LEVEL_OPTIONS = {"debug": 10, "info": 20, "warn": 30, "error": 40}

MASK = "<mask>"
CONTEXT_WINDOW = 128
NUM_RESULTS = 10
MAX_LENGTH = 512
DEFAULT_MEDIATYPE = "application/vscode-jsonrpc"
DEFAULT_CHARSET = "utf-8"
PUBLISHED_TARGET_MS = 33
# --- end of fixed values ---------------------------------------------------------


def routes(spark: SparkSession) -> DataFrame:
    """The 36 endpoints: endpoint, scope, name, reqres, implemented."""
    rows = [(f"{s}/{n}" if s else n, s, n, r, i) for s, n, r, i in ROUTES]
    return spark.createDataFrame(
        rows, "endpoint string, scope string, name string, reqres boolean, implemented boolean")


def error_codes(spark: SparkSession) -> DataFrame:
    """The named error codes: code, name, family."""
    return spark.createDataFrame(ERROR_CODES, "code int, name string, family string")
