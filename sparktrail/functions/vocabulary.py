"""Names, word lists and patterns that results depend on."""

# Tool names of two generations.
TOOL_ALIASES = {"execute_bash": "shell", "fs_read": "read", "fs_write": "write", "use_subagent": "subagent"}

# Folded write commands, read modes and single-action tools, and the actions they stand for.
WRITE_ACTIONS = {"create": "create_file", "strreplace": "modify_file", "insert": "modify_file", "append": "modify_file", "delete": "delete_file"}
READ_MODES = {"line": "read_file", "directory": "list_dir", "image": "read_image", "search": "search_content"}
SINGLE_ACTIONS = {"grep": "search_content", "glob": "search_files", "summary": "summarize", "subagent": "spawn_subagent", "use_aws": "aws_call", "introspect": "docs_query", "code": "code_query", "shell": "run_command"}

# Actions that count as writing, for each consumer.
WRITES_PRODUCES = ("create_file", "modify_file", "write", "append_file")
WRITES_EVIDENCE = ("create_file", "modify_file", "append_file")
WRITES_EFFICIENCY = ("write_file", "modify_file", "create_file", "edit_file")
WRITES_STATS = ("create_file", "modify_file")

# Default map of intents to actions, verbs and patterns.
INTENT_MAP = {
    "read_actions": ["read_file", "list_dir", "read_image", "search_content", "search_files"],
    "read_shell_verbs": ["cat", "bat", "sed", "awk", "grep", "egrep", "rg", "head", "tail", "less", "more", "nl", "wc", "xxd", "od", "jq", "yq"],
    "read_idioms": [r"json\.load", r"\.read\(", r"\.readlines\(", r"open\([^),]*\)"],
    "run_prefixes": [r"timeout\s+\d+\s+", r"sudo\s+", r"env\s+", r"\w+=\S+\s+", r"nice\s+(?:-n\s+\d+\s+)?", r"exec\s+", r"stdbuf\s+\S+\s+", r"python3?\s+-m\s+"],
    "write_actions": ["create_file", "modify_file", "append_file"],
    "write_shell_ops": [">>", ">", "tee", "dd"],
    "write_idioms": [r"open\([^)]*['\"][wa]", r"\.write\(", r"\.writelines\(", r"json\.dump\(", r"\.to_csv\(", r"\.to_json\("],
}

# Default scoring.
SCORING = {
    "weights": {"required": 1.0, "forbidden": 1.0, "recommended": 0.5, "optional": 0.25},
    "binarize_checkers": ["Milestone"],
    "verdict": {"fail_on_required_miss": True, "fail_on_forbidden_hit": True, "weak_on_recommended_miss": True},
}
SEVERITIES = ("required", "forbidden", "recommended", "optional")

# Order of fields in an action's serialised text, and field groups of a matcher.
SERIALISED = ("action", "tool", "command", "path", "root", "pattern")
EQUAL_KEYS = ("action", "tool", "raw_tool", "pattern")
CONTAINED_KEYS = ("path", "command", "root")
