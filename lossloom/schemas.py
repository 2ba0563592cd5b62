"""Declared schemas. Sources are always read with these, never with inference."""

LEDGER = (
    "section_id string, ledger_id bigint, sample string, instruct string, gold_summary string, "
    "student_ans string, token_length int, loss double, tag string, round_id int, source string, "
    "source_ledger_id bigint"
)
EVALUATION = (
    "section_id string, round_id int, slot_id bigint, sample string, instruct string, "
    "gold_summary string, student_ans string, token_length int, loss double, tag string, "
    "source string, source_ledger_id bigint"
)
BATCH = (
    "section_id string, round_id int, slot_id int, sample string, instruct string, "
    "gold_summary string, tag string, source string, source_ledger_id bigint"
)
VAULT = (
    "section_id string, pos int, ledger_id bigint, tag string, token_length int, loss double, "
    "recycle_count int, last_recycled_round int, active boolean, retired_reason string, "
    "first_seen_round int, last_seen_round int, last_loss double, best_recycle_loss double"
)
RECIPE = (
    "section_id string, round_id int, slot_id int, command string, tag string, "
    "failure_ledger_id bigint"
)
STATE = (
    "section_id string, current_round int, consecutive_no_recycle int, example_format string, "
    "task_mode string, bad_round_streak int, best_round_id int, best_eval_loss double, "
    "raw_best_round_id int, raw_best_eval_loss double, base_override_round int"
)
EXAMPLE = "sample string, output string, instruct string, context string, mode string"
EVAL_LOSS = "run string, batch_index int, loss double"
ROUND_LOSS = "section_id string, round_id int, decision_loss double, complete boolean"
EVENT = "timestamp timestamp, section_id string, event_type string, payload string"
CACHE = "cache_key string, cache_version string, model_id string, prompt string, response string"


def columns(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(",")]
