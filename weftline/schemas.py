"""Declared schemas of the tables; nothing is inferred."""

SYSTEM_PROMPTS = "id string, system_prompt string, category string, complexity string, domain string, estimated_tokens int, generation_batch int"
QUESTIONS = "system_prompt_id string, questions array<struct<id:string,question:string,on_topic:boolean,type:string,difficulty:string,intent:string,tags:array<string>>>"
RESPONSES = "system_prompt_id string, question_id string, model string, raw_response string, answer string, input_tokens int, output_tokens int, truncated boolean"
FILTERED_PAIRS = "question_id string, system_prompt_id string, kept boolean, reason string, edit_distance double, trigram_jaccard double, off_topic boolean"
SPLIT_EXAMPLES = (
    "context string, question string, answer string, answer_8b string, difficulty_weight double, filter_metrics struct<norm_edit_distance:double,jaccard_similarity:double,length_ratio:double>, "
    "system_prompt_id string, question_id string, category string, question_type string, question_difficulty string"
)
QA_CORPUS = "contextlen int, conversationlen int, context string, conversations array<struct<role:string,content:string>>"
MQA = "context string, conversations array<struct<question:string,answer:string>>"
HUMAN = "context string, questions array<string>"
ADVERSARIAL = "system_prompt_id string, category string, question_type string, difficulty_weight double, context string, question string, notes string, question_id string, teacher_answer string, answer_8b string"
TOOL_ENTRIES = "id string, instruction string, output string"
PREDICTIONS = "sample_idx bigint, evidence string, input string, question string, think string, answer string, ground_truth variant, f1 double"
