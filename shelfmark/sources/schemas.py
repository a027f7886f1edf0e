"""Schemas of the files and tables read and written."""

PRODUCT = (
    "id string, title string, category string, price double, inventory string, attributes string, "
    "description string, reviews array<string>, qa array<struct<q:string,a:string>>, updated_at string, "
    "source_asin string, category_aliases_zh array<string>"
)
POLICY = "id string, title string, policy_type string, scope string, content string, updated_at string"
RAW_CATALOGUE = (
    "parent_asin string, asin string, title string, description string, features array<string>, "
    "details map<string,string>, categories array<string>, main_category string, category string, "
    "price string, store string"
)
RAW_REVIEW = (
    "parent_asin string, asin string, text string, review_text string, title string, "
    "helpful_vote int, helpful_votes int"
)
USERS = "user_id string, name string, verification_code string, address string, payment_methods string"
ORDERS = (
    "order_id string, user_id string, product_id string, status string, ordered_at date, delivered_at date, "
    "opened boolean, quality_issue boolean, inventory_status string, return_status string, version int, "
    "shipping_address string, payment_method_id string, item_ids string, cancel_reason string, exchange_status string"
)
HANDOFFS = "handoff_id string, user_id string, order_id string, reason string, created_at timestamp"
TASK = (
    "task_id string, category string, user_id string, user_goal string, seed int, gold_doc_ids array<string>, "
    "allowed_tools array<string>, forbidden_tools array<string>, expected_state map<string,map<string,string>>, "
    "initial_state map<string,map<string,string>>, metadata string, split string, answer_expectations string, "
    "expected_tool_sequence array<string>"
)
AUDIT = (
    "simulation_id string, process_compliant boolean, violations array<string>, reviewer string, audit_version string"
)
_CALL = "struct<id:string,name:string,arguments:string,function:struct<name:string,arguments:string>>"
_USAGE = "struct<prompt_tokens:bigint,completion_tokens:bigint>"
MESSAGE = (
    f"struct<role:string,content:string,error:boolean,tool_call_id:string,name:string,tool_calls:array<{_CALL}>,"
    f"usage:{_USAGE},generation_time_seconds:double,raw_data:struct<model:string,usage:struct<prompt_tokens:bigint,"
    "completion_tokens:bigint,prompt_cache_hit_tokens:bigint,prompt_cache_miss_tokens:bigint>>>"
)
SIMULATION = (
    "struct<id:string,task_id:string,trial:int,seed:int,termination_reason:string,start_time:string,end_time:string,"
    "reward_info:struct<reward:double,db_check:struct<db_match:boolean>,"
    "action_checks:array<struct<tool_type:string,action_match:boolean>>,nl_assertions:array<string>>,"
    f"messages:array<{MESSAGE}>>"
)
RESULTS = f"simulations array<{SIMULATION}>"
TRAJECTORY_STORE = "trajectory_id string, task_id string, seed int, trajectory_json string, grade_json string, version bigint"
