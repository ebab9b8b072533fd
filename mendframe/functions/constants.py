"""Fixed values of the cleaning rules.

Everything here is a value that decides results (candidate delimiters,
patterns, thresholds, message prefixes).  Values are stated once, in natural
order, and used by the expression builders of this package.
"""

# --- fixed values: delimiters and encodings -------------------------------
CANDIDATE_DELIMITERS = [",", ";", "\t", "|"]
DELIMITER_LABELS = {"\t": "TAB", ",": "Comma", ";": "Semicolon", "|": "Pipe"}
SNIFFER_PREFERENCE = [",", "\t", ";", "|"]
ACCEPTED_EXTENSIONS = ["csv", "tsv", "txt"]
# Bytes that have no meaning in cp1252; a file holding one is read as latin-1.
CP1252_UNDEFINED = "\u0081\u008d\u008f\u0090\u009d"

# --- fixed values: detection windows --------------------------------------
SAMPLE_CHARS = 16384
SAMPLE_LINES = 30
LEGACY_SAMPLE_CHARS = 8192
LEGACY_SAMPLE_LINES = 20
HEADER_SCAN_LINES = 60
BINARY_SNIFF_BYTES = 4096

# --- fixed values: delimiter choice ---------------------------------------
EURO_SCORE_DISTANCE = 0.35
EURO_MIN_DENSITY = 0.06

# --- fixed values: header choice ------------------------------------------
HEADER_TIE = 0.10
HEADER_PREFER_WITHIN = 10
HEADER_MAX_PREAMBLE = 15
HEADER_MIN_GAP = 0.75

# --- fixed values: weights of the header score ----------------------------
SCORE_LETTERS = 4.0
SCORE_NUMBERS = -5.0
SCORE_DATES = -4.0
SCORE_DISTINCT = 2.0
SCORE_MEAN_LENGTH = -0.05
SCORE_TITLE = -3.0
ISO_DATE = r"^\d{4}-\d{2}-\d{2}"

# --- fixed values: header-likeness ----------------------------------------
SLASH_DATE = r"^\d{1,2}/\d{1,2}/\d{2,4}"
COMPACT_DATE = r"^\d{8}(_\d{6})?$"
SHORT_CODE = r"^[A-Za-z]\d{1,3}$"
LONG_NUMBER = r"^\d{6,}$"
PLAIN_LABEL = "^[A-Za-z_][A-Za-z0-9_]*$"
LABEL_MAX_LENGTH = 24
LABEL_MIN_SHARE = 0.60
DATA_MAX_SHARE = 0.30

# --- fixed values: numbers ------------------------------------------------
EURO_NUMBER = r"^\(?-?\d{1,3}([.\s]\d{3})*,\d+\)?$"
US_NUMBER = r"^\(?-?\d{1,3}(,\d{3})*(\.\d+)?\)?$"
PLAIN_NUMBER = r"^[-+]?\d+(\.\d+)?$"
NUMERIC_MIN_VALUES = 5
NUMERIC_MIN_SHARE = 0.85

# --- fixed values: columns left out of near-duplicate comparison ----------
IGNORED_NAME = (
    "^id$|_id$|^id_|_id_|uuid|guid|transaction|txn|reference|^ref$|ref_|_ref$"
    "|date|time|_at$|balance|running_total|remaining"
)

# --- fixed values: limits and retention -----------------------------------
SERVICE_LIMITS = {
    "max_bytes": 20 * 1024 * 1024,
    "max_rows": 200_000,
    "max_cols": 300,
}
RETENTION_MINUTES = 30
RATE_WINDOW_SECONDS = 60
RATE_MAX_HITS = 10
PREVIEW_ROWS = 10
NEAR_DUP_EXAMPLES = 5

# --- fixed values: report messages ----------------------------------------
REPAIR_MESSAGE = (
    "^(Fixed |Removed |Normalized |Header missing|Header detected)"
    "|Converted to UTF-8|Quote stitching: merged"
)
HEADER_DEBUG_PREFIXES = [
    "Header candidates",
    "Header selected",
    "Header score gap",
    "Header modal field count",
    "Header chosen after tie-break",
]

# --- rule: whitespace -----------------------------------------------------
# Unicode White_Space plus the four ASCII separators U+001C..U+001F.
WHITESPACE = "".join(
    [chr(c) for c in range(0x09, 0x0E)]
    + [chr(c) for c in range(0x1C, 0x21)]
    + ["\u0085", "\u00a0", "\u1680"]
    + [chr(c) for c in range(0x2000, 0x200B)]
    + ["\u2028", "\u2029", "\u202f", "\u205f", "\u3000"]
)

# --- rule: cp1252 characters of the bytes 0x80..0x9F ----------------------
CP1252_C1_CHARS = "".join(
    chr(b) for b in range(0x80, 0xA0) if chr(b) not in CP1252_UNDEFINED
)
CP1252_CHARS = "".join(bytes([ord(c)]).decode("cp1252") for c in CP1252_C1_CHARS)
