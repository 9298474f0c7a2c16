"""Stored tokens and default numbers.

These are fixed values: they are data that other systems already hold, so they
must be spelled exactly like this for results to agree.
"""

# Gates in cascade order.
G1 = "G1_NEUTRAL"
G2 = "G2_CORROBORATION"
G3 = "G3_CONTRADICTION"
G4 = "G4_ESCALATION"
GATES = (G1, G2, G3, G4)

# Run and gate states.
RUN_STATES = ("REQUESTED", "RUNNING", "SUCCEEDED", "FAILED", "SUPERSEDED")
OPEN_RUN_STATES = ("REQUESTED", "RUNNING")
GATE_STATES = ("PENDING", "RUNNING", "SUCCEEDED", "FAILED", "SKIPPED")
RUN_MODES = ("FULL", "FROM_GATE")
TRIGGERS = ("OPERATOR", "SYSTEM", "SWEEPER")

# Relations between two claims.
NEUTRAL = "NEUTRAL"
REPEATS = "REPEATS"
CORROBORATES = "CORROBORATES"
CONTRADICTS = "CONTRADICTS"
VERDICTS = (NEUTRAL, REPEATS, CORROBORATES, CONTRADICTS)
DECIDABLE_VERDICTS = (NEUTRAL, REPEATS, CORROBORATES)

# What a gate does with a pair.
DECIDED = "DECIDED"
FORWARD = "FORWARD"
ESCALATE_G4 = "ESCALATE_G4"
ROUTE_HUMAN = "ROUTE_HUMAN"

# Who produced a verdict row.
METHOD_G1 = "GK_G1_NLI"
METHOD_G2 = "GK_G2_GROUNDING"
METHOD_G3 = "GK_G3_XCHECK"
METHOD_G4 = "GK_G4_LLM"
CASCADE_METHODS = (METHOD_G1, METHOD_G2, METHOD_G3)
OWN_METHODS = CASCADE_METHODS + (METHOD_G4,)
LABEL_METHODS = ("ENSEMBLE", "RULE", "EMBEDDING")
KEY_STAMP = "GK"

# Why a pair left the cascade, and the routing tiers.
CONTRADICTION_SIGNAL = "CONTRADICTION_SIGNAL"
STAGE_DISAGREEMENT = "STAGE_DISAGREEMENT"
CONTEXT_DISAGREEMENT = "CONTEXT_DISAGREEMENT"
CAP_EXCEEDED = "CAP_EXCEEDED"
LLM_ERROR = "LLM_ERROR"
TIER_CASCADE = "CASCADE"
TIER_LLM = "LLM_TAIL"
TIER_HUMAN = "HUMAN"

# Who is allowed to decide a run. The token that means "this
# cascade decides" is a parameter wherever it is read from stored run
# parameters (``deciding_token``); CASCADE is only its default spelling.
MODE_LLM = "LLM"
MODE_DECIDING = "CASCADE"
MODE_SHADOW = "SHADOW"
WOULD_ESCALATE = "WOULD_ESCALATE_LLM"

# Default thresholds, as named in a frozen settings snapshot.
THRESHOLD_PATHS = {
    "neutral_min": ("g1.neutralMin", 0.95),
    "repeat_min": ("g1.repeatMin", 0.90),
    "contra_escape": ("g1.contraEscape", 0.02),
    "support_min": ("g2.supportMin", 0.90),
    "support_floor": ("g2.supportFloor", 0.50),
    "contra_min": ("g3.contraMin", 0.85),
    "neutral_consensus": ("g3.neutralConsensus", 0.10),
}

# The thresholds a sweep or grid may vary, by their snapshot name.
SWEEPABLE = {
    "neutralMin": "neutral_min",
    "repeatMin": "repeat_min",
    "contraEscape": "contra_escape",
    "supportMin": "support_min",
    "contraMin": "contra_min",
    "neutralConsensus": "neutral_consensus",
}

# Remaining run settings and their defaults.
DEFAULT_MODELS = {
    "g1": "modernbert-base-nli@v1",
    "g2": "minicheck-deberta-l@v1",
    "g3": "deberta-mnli-fever-anli@v1",
}
DEFAULT_LLM_MODEL = "gemini-2.5-flash-lite"
DEFAULT_MAX_SEQ_TOKENS = 512
DEFAULT_MAX_LLM_PAIRS = 3000
DEFAULT_THINKING_BUDGET = 512
USD_PER_MILLION_INPUT = 0.10
USD_PER_MILLION_OUTPUT = 0.40
CORPUS_SCHEMA_VERSION = 1
SCORE_TABLE_VERSION = 2
REQUEST_SCHEMA_VERSIONS = (1,)

# Acceptance criteria of a replay.
GO_BAR = {
    "neutralPrecision": (">=", 0.95),
    "neutralCoverage": (">=", 0.60),
    "contradictsRecall": (">=", 0.95),
    "g4Share": ("<=", 0.05),
}

# Counters every gate reports, zero when nothing happened.
G1_COUNTERS = (
    "seen", "neutral", "repeats", "contraFlagged", "forwarded", "truncated", "ctxDisagreed",
)
G2_COUNTERS = (
    "seen", "corroborates", "forwarded", "grounded", "flaggedPassThrough", "truncated",
)
G3_COUNTERS = ("seen", "neutral", "humanRouted", "escalated", "truncated")
G4_COUNTERS = (
    "seen", "decided", "capExceeded", "llmError", "llmCalls", "promptTokens",
    "outputTokens", "shadowSuppressed", "llmSpendUsd",
)
