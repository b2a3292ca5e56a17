"""Word lists, prefixes and patterns that results depend on."""

from __future__ import annotations

ERROR_STATUSES = ("tool_error", "error", "failed", "failure")
NO_TOOL = ("", "none", "respond")
ROLE_PREFIXES = ("user:", "assistant:", "tool[", "tool:", "system:")
BLOCK_STARTS = ("output=", "stdout:", "stderr:", "diff:", "patch:", "traceback", "error:", "warning:", "file:")
STATUS_WORDS = ("error", "success", "fail", "invalid", "warning")

# --- process tags ----------------------------------------------------------------------------------------------------
PROCESS_METADATA = (
    "dataset=", "task_id=", "trial_name=", "condition_dir=", "agent_name=", "agent_model_name=", "trace_format=", "step_index=",
    "initial_prompt=", "task_prompt=", "recent_reasoning=", "episode_index=", "episode_prompt=",
)
TRACE_FAMILIES = {
    "claude_session_jsonl": "claude_dialogue",
    "claude_code_txt": "claude_dialogue",
    "codex_txt": "codex_exec",
    "gemini_cli_trajectory_json": "gemini_exec",
    "gemini_cli_txt": "gemini_text",
    "trajectory_json": "trajectory_exec",
}
VERIFY = ("verify", "verification", "confirm", "check the result", "check output", "mass_report", "verify_filled", "final answer")
TEST = ("pytest", "unittest", "go test", "cargo test", "integration test", "failing build")
BUILD = ("pip install", "npm install", "yarn install", "make ", "cmake", "cargo build", "compile", "build ", "package", "javac")
INSPECT = (
    "read ", "inspect", "examine", "list ", "search", "lookup", "head ", "tail ", "grep ", "find ", "which ", "pip list", "cat ", "od ", "hexdump", "google_web_search",
)
EDIT = ("create ", "write ", "edit ", "update ", "modify ", "patch ", "mkdir ", "touch ", "rm ", "mv ", "cp ", "sed ", "fill ")
ERROR_WORDS = ("traceback", "error", "failed", "exception", "not found", "syntax error")
RETRY = ("retry", "rerun", "run again", "again", "still", "another attempt")
RETRY_PATTERN = ("retry", "rerun", "run again", "again", "still")
SAME_COMMAND = ("rerun the script", "rerun the command", "run again", "retry the script")
PROCESS_PROFILES = {"phase-v1": ("phase",), "process-full-v1": ("phase", "error_persistence", "retry_pattern", "progress_state")}

# --- dialogue tags ---------------------------------------------------------------------------------------------------
DIALOGUE_PROFILES = {
    "semantic-tool-role-v1": ("tool_role",),
    "semantic-tool-role-obligation-v1": ("tool_role", "verification_obligation"),
    "semantic-tool-role-obligation-state-v1": ("tool_role", "verification_obligation", "obligation_state"),
    "semantic-full-v1": ("tool_role", "verification_obligation", "argument_risk", "result_state"),
}
GUIDANCE = (
    "please provide", "could you provide", "can you provide", "please go to", "go to ", "click ", "select ", "open ", "turn on", "turn off", "enable ",
    "disable ", "log in", "sign in", "update ", "change ", "you can ", "you should ", "you'll need to ", "please check", "please contact", "i recommend that you",
)
QUERY = (
    "?", "could you", "can you", "would you", "may i have", "please provide", "please confirm", "what is", "what's", "which ", "when ", "where ", "who ",
    "do you ", "is that correct",
)
IDENTITY = (
    "verify", "verification", "confirm", "billing zip", "zip code", "postal code", "last four", "phone number", "email address", "account holder", "full name",
    "date of birth", "security question", "identity", "authenticate", "authentication",
)
LOOKUP = ("order number", "reservation", "booking", "tracking number", "reference number", "account number", "member id", "confirmation code")
OPTION = (
    "which option", "which item", "which one", "would you like", "do you want", "choose", "select", "preference", "seat", "plan", "package", "delivery method",
    "color", "size",
)
CONSTRAINT = (
    "when", "where", "what time", "which date", "date", "time", "address", "quantity", "amount", "reason", "details", "constraint", "availability",
)
CONFIRM = ("confirm", "is that correct", "does that look right", "just to confirm", "can you verify")
TOOL_IRREVERSIBLE = ("cancel", "refund", "exchange", "replace", "remove", "delete", "terminate", "close_account")
TOOL_QUOTE = ("quote", "estimate", "price", "preview")
TOOL_CHECK = ("check", "validate", "verify", "confirm")
TOOL_READ = ("get", "list", "search", "find", "lookup", "fetch", "retrieve")
POLICY = ("policy", "eligibility", "approval", "consent", "terms", "verification is complete", "verification complete", "blocked")
OBLIGATION_IDENTITY = (
    "identity", "authenticate", "authentication", "billing zip", "zip code", "postal code", "last four", "security question", "date of birth",
)
ACCOUNT = ("account", "reservation", "booking", "order", "customer", "member", "account_id", "reservation_id", "order_id", "customer_id")
ACCOUNT_TOOLS = ("get_reservation_details", "get_order_details", "get_customer_details")
KEY_IDENTIFIER = ("id", "code", "number", "account", "reservation", "order", "customer", "member")
KEY_TIME = ("date", "time", "departure", "arrival", "schedule")
KEY_QUANTITY = ("quantity", "amount", "price", "payment", "qty", "count", "units")
RESULT_POLICY = ("policy", "eligibility", "approval", "blocked", "verification is complete", "verification complete")
RESULT_EMPTY = ("not found", "no matching", "none found", "empty", "unavailable")
RESULT_WRITTEN = (
    "success", "updated", "changed", "cancelled", "canceled", "booked", "created", "refunded", "exchanged", "scheduled", "completed",
)
SUMMARY_ERROR = ("error", "failed", "failure", "rejected", "unable", "cannot")
SUMMARY_MANY = ("matches", "options", "available flights", "available orders", "results")
SUMMARY_FOUND = ("found", "located", "verified", "fee", "reservation", "order", "account")

# --- cleaning and audits ---------------------------------------------------------------------------------------------
DROP_RULES = (
    ("explicit_verifier_key", r"(?i)\bresult\.verifier_result\b"),
    ("explicit_verifier_key", r"(?i)\bsource_result\b"),
    ("explicit_verifier_key", r"(?i)\braw_reward\b"),
    ("explicit_verifier_key", r"(?i)\blabel_origin\s*=\s*result\.verifier_result\.rewards\.reward\b"),
    ("explicit_verifier_key", r"(?i)\breward\s*=\s*(?:0(?:\.0+)?|1(?:\.0+)?)\b"),
    ("explicit_verifier_key", r"(?i)test-stdout\.txt"),
    ("explicit_verifier_key", r"(?i)reward\.txt"),
)
REWRITE_RULES = (
    ("evaluator_protocol", r"(?im)\b(?:the\s+)?(?:verifier|evaluator)\s+will\b[^\n]*", " [redacted_instruction]"),
    ("verifier_path", r"(?i)/logs/verifier(?:/[^\s\"'`]+)?", "[redacted_path]"),
    ("verifier_path", r"(?i)/root/verifier(?:-skills)?(?:/[^\s\"'`]+)?", "[redacted_path]"),
    ("verifier_path", r"(?i)\bverifier-skills\b", "[redacted_path]"),
    ("evaluator_test", r"(?i)/tests/test_outputs\.py", "[redacted_file]"),
)
RESIDUAL_RULES = (
    ("verifier_protocol_residual", r"(?i)\b(?:the\s+)?verifier\s+will\b"),
    ("evaluator_protocol_residual", r"(?i)\b(?:the\s+)?evaluator\s+will\b"),
    ("verifier_path_residual", r"(?i)/logs/verifier(?:/|$)"),
    ("verifier_path_residual", r"(?i)/root/verifier(?:-skills)?(?:/|$)"),
    ("evaluator_test_residual", r"(?i)/tests/test_outputs\.py"),
)
