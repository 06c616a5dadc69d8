"""Row schemas of every stage, in DDL."""

EXAMPLE = "struct<input:string,output:string>"
RAW_PROBLEM = f"id string, prompt string, generation string, description string, examples array<{EXAMPLE}>, time_limit double, memory_limit double, input_format string, output_format string, note string, title string, contest_name string, contest_start_year int"
SOLUTIONS = f"idx bigint, source_id string, prompt string, response string, problem_statement string, time_limit double, memory_limit double, input_format string, output_format string, examples array<{EXAMPLE}>, problem_notes string, title string, contest_name string, contest_start_year int"
PROMPT = "idx string, prompt string"
RL_ROW = f"idx string, test_cases array<{EXAMPLE}>, lang string, prompt string"
RESPONSE = "idx string, sample_idx int, prompt string, response string"
ANSWER = "idx string, sample_idx int, issues string, answer string"
ITEM = f"item_id string, code string, test_cases array<{EXAMPLE}>, lang string"
RESULT = "item_id string, status string, expected string, got string, stdout string, stderr string, exit_code int, timeout_s double, details string"
EXTRAS = ["expected", "got", "stdout", "stderr", "exit_code", "timeout_s", "details"]
