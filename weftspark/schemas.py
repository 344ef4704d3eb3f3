"""Schemas of the rows that are read from and written to files."""

MESSAGES = "array<struct<role string, content string>>"
INFO = "struct<model_name string, temperature double, max_tokens int, n int, best_rank int, worst_rank int>"
SFT = f"source string, pos bigint, messages {MESSAGES}"
PREFERENCES = f"prompt string, prompt_id string, chosen {MESSAGES}, rejected {MESSAGES}, messages {MESSAGES}, score_chosen double, score_rejected double, other_info {INFO}"
GENERATIONS = f"prompt_id string, prompt_messages {MESSAGES}, gen_answers array<string>, other_info {INFO}"
PACKED = "input_ids array<int>, labels array<int>, cu_seqlens array<int>"
QUESTIONS = "question_id int, category string, turns array<string>, reference array<string>, required_temperature double"
ARENA_QUESTIONS = "question_id string, category string, turns array<struct<content string>>"
ANSWERS = "question_id int, answer_id string, model_id string, choices array<struct<index int, turns array<string>>>, tstamp double"
ARENA_ANSWERS = "question_id string, answer_id string, model_id string, choices array<struct<index int, turns array<struct<content string, token_len int>>>>, tstamp double"
JUDGE_PROMPTS = "name string, type string, system_prompt string, prompt_template string, output_format string"
SINGLE_JUDGMENTS = "question_id int, model string, judge array<string>, user_prompt string, judgment string, score double, turn int, tstamp double"
PAIR_JUDGMENTS = (
    "question_id int, model_1 string, model_2 string, winner string, g1_winner string, g2_winner string, judge array<string>, g1_user_prompt string, g1_judgment string,"
    " g2_user_prompt string, g2_judgment string, turn int, m1_score double, m2_score double, tstamp double"
)
ARENA_JUDGMENTS = "question_id string, model string, judge string, games array<struct<user_prompt string, judgment string, score string>>"
BATTLES = "question_id string, model_a string, model_b string, winner string"
OUTPUTS = "instruction string, output string, dataset string, datasplit string, generator string"
