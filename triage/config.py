"""Configuration: signature patterns, thresholds and the fixed texts of each analyzer.

Everything a user may override lives in :class:`TriageConfig`; the functions in
``triage.operators`` turn these values into column literals, so changing a value
never changes the shape of the Spark plan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# FIXED VALUES — these must equal the behaviour being reproduced, character for
# character.  They are stated here together, in their natural order.
# ---------------------------------------------------------------------------

# Failure signatures, in configuration order (the order of matched_patterns).
SIGNATURES: dict[str, str] = {
    "SchemaMismatch": r"(SchemaMismatch|missing columns|missing column|unexpected column)",
    "OOM": r"OutOfMemoryError|OOM|java.lang.OutOfMemoryError|GC overhead|heap space",
    "Skew": r"skew|hotkey|skew_ratio|PerformanceAlert",
    "GC": r"GC overhead|full gc|garbage collection",
    "MissingFile": r"(NoSuchFileException|FileNotFoundException|File not found|not found:)",
    "AuthError": r"Auth|Authentication|permission denied|403|AccessDenied",
}

# Which matched signature names the error type, highest first.
PRIORITY: list[str] = ["OOM", "SchemaMismatch", "Skew", "MissingFile", "AuthError", "GC"]

MAX_LINES = 3000
EXCERPT_CHARS = 4000

# A line counts as an exception line when it contains one of these (any case).
EXCEPTION_LINE = r"Exception|Error|Traceback|PerformanceAlert|OutOfMemoryError"
NO_EXCEPTION_LINE = "No explicit exception line found"

# Extraction patterns used by the analyzers (case-insensitive unless noted).
SHUFFLE_BYTES = r"shuffle[_ ]?bytes[^0-9]*([0-9]+)"
MISSING_COLUMNS = r"missing columns[:\s]*\[?([^\]]+)\]?"
EXTRA_COLUMNS = r"extra columns[:\s]*\[?([^\]]+)\]?"
COLUMN_STRIP_CHARS = " '\""
OOM_PHRASE = r"OutOfMemoryError|heap space|GC overhead"
INSTANCE_HINT = r"(executor_\d+|driver)_?(\d+)?"
SKEW_RATIO = r"skew_ratio\s*=\s*([0-9]*\.?[0-9]+)"
HOTKEY_COUNT = r"hotkey_count\s*=\s*([0-9]+)"
TOTAL_RECORDS = r"total_records\s*=\s*([0-9]+)"
MISSING_FILE_PHRASE = r"NoSuchFileException|FileNotFoundException|File not found|not found:"
PATH_TOKEN = r"(/[\w\-\./]+)"  # case-sensitive
AUTH_PHRASE = r"Auth|Authentication|permission denied|403|AccessDenied|401"
GC_PHRASE = r"GC overhead|Full GC|garbage collection"

# Thresholds.
SKEW_RATIO_THRESHOLD = 0.5
BROADCAST_SIZE_BYTES = 104857600  # 100 MB
SHUFFLE_BYTES_HIGH = 1000000000  # 1 GB, used by the analyzers
SHUFFLE_BYTES_PLAN = 500000000  # 0.5 GB, used by the fix recommender
CONFIDENCE_GATE = 0.7
REPARTITION_N = 200

# Evidence texts.
EV_MISSING_COLUMNS = "Detected missing columns: "
EV_EXTRA_COLUMNS = "Detected extra columns: "
EV_DEMO_AMT = "Found 'amt' in data; expected 'amount' (demo pattern)"
EV_OOM = "Detected Java/Python OutOfMemoryError in logs."
EV_INSTANCE = "Instance hint: "
EV_SHUFFLE = "shuffle_bytes="
EV_SKEW_RATIO = "Detected skew_ratio="
EV_MISSING_PATH = "Missing path: "
EV_GC = "Garbage collection pressure detected."

# Per error type: root cause text, suggested actions, remediation hint, confidence.
ROOT_CAUSE = {
    "SchemaMismatch": "Schema mismatch between expected and incoming data fields.",
    "OOM": "OutOfMemory (OOM) encountered during job execution.",
    "Skew": "Data skew on join key leading to performance hotspot.",
    "MissingFile": "Input file or resource not found.",
    "AuthError": "Authentication/Authorization error when accessing resource.",
    "GC": "Frequent garbage collection causing performance degradation and possible OOM.",
    "Other": "Unknown / unclassified error. Manual investigation required.",
}
ACTIONS = {
    "SchemaMismatch": ["schema_update", "code_patch", "data_provider_alert"],
    "OOM": ["config_change", "increase_executor_memory", "optimize_transformations"],
    "OOM_large_shuffle": ["config_change", "code_patch", "optimize_join"],
    "Skew": ["code_patch", "salting", "repartition"],
    "Skew_low": ["monitor", "investigate"],
    "Skew_large_shuffle_extra": ["broadcast_or_repartition"],
    "MissingFile": ["data_availability_check", "alert", "retry"],
    "AuthError": ["secrets_check", "credential_rotation", "alert"],
    "GC": ["config_change", "tune_gc", "increase_memory"],
    "Other": ["manual_review", "collect_more_data"],
}
REMEDIATION = {
    "SchemaMismatch": "Update StructType/read schema or add tolerant parsing and notify data provider.",
    "OOM": "Consider increasing executor memory, reducing shuffle, or using broadcast joins for small dimension tables.",
    "Skew": "Add salting on the join key or pre-aggregate hot partitions; consider repartitioning before join.",
    "Skew_low": "Skew suspected; collect more metrics.",
    "MissingFile": "Verify upstream data landing, storage permissions, and retry logic.",
    "AuthError": "Check service account permissions, token expiry and secret validity.",
    "GC": "Tune JVM GC or increase executor memory; investigate large object retention.",
    "Other": "Open for manual investigation and attach more logs or metrics.",
}
FIXED_CONFIDENCE = {"MissingFile": 0.85, "AuthError": 0.9, "GC": 0.8, "Other": 0.4}

# Fix rules: name -> (description, trigger actions, base confidence).
FIX_RULES = {
    "broadcast_join": (
        "Apply broadcast join when one side is small",
        ["optimize_join", "broadcast_or_repartition", "code_patch"],
        0.8,
    ),
    "repartition_before_groupby": (
        "Add repartition before expensive groupBy/aggregate",
        ["optimize_join", "repartition", "code_patch"],
        0.7,
    ),
    "rename_column_schema": (
        "Rename incoming column to expected name",
        ["schema_update", "code_patch"],
        0.9,
    ),
    "salting_skew": ("Add salting for extreme skew", ["salting", "code_patch"], 0.7),
    "config_hint": (
        "Suggest executor memory/config changes",
        ["increase_executor_memory", "config_change"],
        0.6,
    ),
}

# Routing of root-cause records to the next step (documented routing).
ROUTES = {"code_patch": "fixer", "data_provider_alert": "notifier"}

# Outcome texts of event handling.
LOG_NOT_FOUND = "log file not found: "
NO_JOB_FILE = "No job file to patch"
JOB_DIR = "pipeline/jobs/"
NO_CHANGE_EXPLANATION = "No safe automated change found for this job based on RCA."
DEFAULT_REPORT_CONFIDENCE = 0.75

# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class TriageConfig:
    """User-tunable settings.  Defaults reproduce the reference behaviour."""

    signatures: dict[str, str] = field(default_factory=lambda: dict(SIGNATURES))
    priority: list[str] = field(default_factory=lambda: list(PRIORITY))
    max_lines: int = MAX_LINES
    skew_ratio_threshold: float = SKEW_RATIO_THRESHOLD
    shuffle_bytes_high: int = SHUFFLE_BYTES_HIGH
    broadcast_size_bytes: int = BROADCAST_SIZE_BYTES
    # Q1: by default the first shuffle-bytes regex always wins (comma-grouped
    # numbers yield their first group); True parses "1,234,567" whole.
    parse_commas: bool = False
    # Q4: bare substrings ("room" is OOM).  True wraps alternatives in \b.
    strict: bool = False
    # Q16: the demo-specific 'amt' vs 'amount' fallback.
    demo_pattern: bool = True


DEFAULT = TriageConfig()
