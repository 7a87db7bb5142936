"""Fixed values that must equal the behaviour being reproduced.

Everything in this module is a literal: limits, constants of the scoring
formulas, reply texts, allow-lists and the default prompt. They are kept
together, in natural order, so that a reader can check them at a glance.
"""

from __future__ import annotations

# --- fixed values: default retrieval settings -------------------------------
DEFAULT_FULL_TEXT_SEARCH_LIMIT = 20
DEFAULT_SEMANTIC_SEARCH_LIMIT = 20
DEFAULT_RRF_LIMIT = 5
DEFAULT_LOOK_BACK = 5
DEFAULT_LOOK_AHEAD = 5

# --- fixed values: scoring ----------------------------------------------------
RRF_K = 60                 # reciprocal-rank-fusion constant: 1 / (60 + rank)
BM25_K1 = 1.2
BM25_B = 0.75
MAX_TOKEN_CHARS = 255      # the full-text tokenizer drops longer tokens
TOKEN_PATTERN = r"[\p{L}\p{N}]+"   # letters and digits, after lower-casing
# Rounding applied before ranking, so that distributed float sums rank the
# same way on every run (and on every engine).
TEXT_SCORE_DIGITS = 9
DISTANCE_DIGITS = 9
RRF_DIGITS = 12

# --- fixed values: chunking ---------------------------------------------------
CHUNK_OVERLAP_CHARS = 5    # overlap budget of the recursive splitter
CHARS_PER_TOKEN = 1        # max chunk chars = model context length * 1

# --- fixed values: models (name, context length) ------------------------------
MODELS = [
    ("support-bot-llama", 31072),
    ("llama3.1", 31072),
    ("snowflake-arctic-embed", 512),
    ("mistral-large-latest", 128000),
    ("mistral-embed", 8192),
]
DEFAULT_CHAT_MODEL = "support-bot-llama"
DEFAULT_EMBEDDINGS_MODEL = "snowflake-arctic-embed"

# --- fixed values: full-text query escaping (18 characters) -------------------
ESCAPED_QUERY_CHARS = ["+", "'", "^", ":", "{", "}", '"', "[", "]", "(", ")",
                       "<", ">", "~", "\\", "!", "*", " "]

# --- fixed values: prompt -----------------------------------------------------
QUERY_VAR = "{{query}}"
CONTEXT_VAR = "{{context}}"
DEFAULT_TASK_CONTEXT = (
    "You are an assistant for question-answering tasks. \n"
    "Use the following pieces of retrieved context to answer the question. \n"
    "If you don't know the answer, just say that you don't know. \n"
    "Use three sentences maximum and keep the answer concise."
)
DEFAULT_QUERY_TEMPLATE = "<query> {{query}} </query>"
DEFAULT_QUERY_CONTEXT_TEMPLATE = "<context> {{context}} </context>"

# --- fixed values: chat and commands ------------------------------------------
RESPONSE_TIMEOUT_SECONDS = 5 * 60
EVENT_RETRIEVAL = "Retrieval"
EVENT_PARTIAL = "Partial"
EVENT_FINISHED = "Finished"
REPLY_UNPARSED = "I'm sorry, I didn't understand that. Your query was `{text}`"
REPLY_UNKNOWN_CONTEXT = ("I'm sorry, I couldn't find any context for {context}. "
                         "Your query was `{text}`")
REPLY_ACK = "Querying the {name} context with `{query}` ..."
NO_DOCUMENTS_RETRIEVED = "No documents retrieved."
COMMAND_FIELDS_REQUIRED = ["api_app_id", "team_id", "team_domain", "channel_id",
                           "channel_name", "user_id", "command", "text",
                           "response_url", "trigger_id", "is_enterprise_install"]
COMMAND_FIELDS_OPTIONAL = ["enterprise_id", "enterprise_name"]
COMMAND_FIELDS = ["api_app_id", "team_id", "team_domain", "enterprise_id",
                  "enterprise_name", "channel_id", "channel_name", "user_id",
                  "command", "text", "response_url", "trigger_id",
                  "is_enterprise_install"]

# --- fixed values: HTML escaping of chunks (order matters: '&' first) --------
HTML_ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"),
                ("'", "&#x27;"), ("/", "&#x2F;"), ("\n", "<br />")]

# --- fixed values: uploads ------------------------------------------------------
MAX_UPLOAD_BYTES = 1073741824  # 1 GiB
ALLOWED_MIME_TYPES = [
    "application/pdf",
    "text/plain",
    "text/html",
    "text/csv",
    "text/xml",
    "application/rtf",
    "application/json",
    "application/xml",
    "application/xhtml+xml",
    "application/vnd.ms-excel",
    "application/msword",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "application/vnd.ms-powerpoint",
    "application/x-vnd.oasis.opendocument.spreadsheet",
    "application/vnd.oasis.opendocument.spreadsheet",
    "application/vnd.oasis.opendocument.presentation",
    "application/vnd.oasis.opendocument.text",
    "application/x-abiword",
    "application/epub+zip",
    "application/x-mobipocket-ebook",
]
FILE_SIZE_UNITS = ["Bytes", "KB", "MB", "GB"]

# --- fixed values: default context ----------------------------------------------
DEFAULT_CONTEXT_NAME = "Support bot"
DEFAULT_CONTEXT_DESCRIPTION = "Your new blank support bot. Configure it to your needs."
DEFAULT_DOCUMENT_TYPE = "PDF"

# --- fixed values: evaluation -----------------------------------------------------
EVAL_THRESHOLD = 0.5
