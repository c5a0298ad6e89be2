"""Identifiers that stored data and recorded responses already carry.

They are wire and storage values, so they are written out plainly and in one place.
"""

# --- fixed values: folders, options and identifier patterns -------------------------------------
NONE_OPTION = "none_of_these"
REVIEW_FOLDER = "human_review"
FAILED_FOLDER = "could_not_process"
RESERVED_FOLDERS = [REVIEW_FOLDER, FAILED_FOLDER]
RESERVED_IDS = [NONE_OPTION, REVIEW_FOLDER, FAILED_FOLDER]
RESERVED_TYPE_IDS = RESERVED_IDS + [
    "con", "prn", "aux", "nul",
    "com1", "com2", "com3", "com4", "com5", "com6", "com7", "com8", "com9",
    "lpt1", "lpt2", "lpt3", "lpt4", "lpt5", "lpt6", "lpt7", "lpt8", "lpt9",
    "constructor", "prototype", "__proto__",
]
TYPE_ID_PATTERN = "^[a-z][a-z0-9]*(?:_[a-z0-9]+)*$"
FINGERPRINT_PATTERN = "^[a-f0-9]{64}$"
JUNK_FILENAMES = [".DS_Store", "Thumbs.db", "__MACOSX"]
SUPPORTED_FORMATS = ["docx", "pptx", "pdf"]

# --- fixed values: policies ---------------------------------------------------------------------
DIGEST_V1 = "named-fields-json-v1"
STATE_V2 = "untrimmed-structured-state-v2"
STATE_V3 = "full-text-outline-v3"
FULL_TEXT_POLICIES = [STATE_V2, STATE_V3]
NOTES_ALL = "all-notes-review-v1"
NOTES_STRUCTURAL_INFO = "full-state-structural-info-v2"
STRUCTURAL_NOTES = ["N_NO_OUTLINE", "N_NO_STRUCTURAL_SECTIONS", "N_OUTLINE_RECOVERED"]
EVIDENCE_EXACT = "exact-substring-v1"
EVIDENCE_SPACING = "whitespace-quotes-v1"
SPEND_HALT = "halt-on-unknown-v1"
SPEND_ISOLATE = "isolate-unlimited-v1"

# --- fixed values: roles, provider scopes, model pins -------------------------------------------
CONFIDENCE, READER, RECOVERY, METADATA = "confidence", "reader", "recovery", "batch_metadata"
SCOPE_OF_ROLE = {CONFIDENCE: "typesafe", READER: "openai", RECOVERY: "openai"}
SCHEMA_CODE = {CONFIDENCE: "E_JEV_SCHEMA", READER: "E_READER_SCHEMA", RECOVERY: "E_RECOVERY_SCHEMA"}
DRIFT_CODE = {CONFIDENCE: "E_JEV_PIN_DRIFT", READER: "E_TERRA_PIN_DRIFT", RECOVERY: "E_LUNA_PIN_DRIFT"}
PIN_PATTERN = {
    CONFIDENCE: r"^jev-[0-9]+\.[0-9]+\.[0-9]+$",
    READER: r"^gpt-(?:5\.6-terra|6-sol)-[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    RECOVERY: r"^gpt-(?:5\.6-luna|6-luna)-[0-9]{4}-[0-9]{2}-[0-9]{2}$",
}
PIN_ALIASES = {
    CONFIDENCE: [],
    READER: ["gpt-5.6-terra", "gpt-6-sol"],
    RECOVERY: ["gpt-5.6-luna", "gpt-6-luna"],
}
QUOTA_CODES = [
    "insufficient_quota", "credit_balance_exhausted", "organization_spend_limit_exceeded",
    "project_spend_limit_exceeded", "organization_usage_limit_exceeded",
]
EFFORTS = ["none", "low", "medium", "high", "xhigh", "max"]

# --- fixed values: limits -----------------------------------------------------------------------
GROUP_BYTES = 8 * 1024 * 1024
SINGLE_BYTES = 32 * 1024 * 1024
BATCH_MAX_REQUESTS = 50_000
BATCH_MAX_BYTES = 200_000_000
MAX_WAIT_MS = 365 * 24 * 60 * 60 * 1000
BATCH_MIN_WAIT_MS = 30_000
MAX_SAFE_INTEGER = 2**53 - 1
CIRCUIT_LIMIT = 3
MAX_TYPES = 254
DEFAULT_THRESHOLD = 0.9
CALL_ATTEMPTS = {"confidence": 3, "recovery": 3, "reader_transport": 3, "reader_schema": 2}
BATCH_STATUSES = ["validating", "failed", "in_progress", "finalizing", "completed", "expired", "cancelling", "cancelled"]
BATCH_TERMINAL = ["completed", "failed", "expired", "cancelled"]
BATCH_LINE_BYTES = 8 * 1024 * 1024
