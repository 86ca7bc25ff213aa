"""Types of the stored tables."""

from __future__ import annotations

ITEMS = (
    "item_id string, family string, difficulty int, structure_seed int, surface_seed int, has_distractor boolean, probe string, grp string, "
    "answer_type string, gold string, choices array<string>, prompt string, turns array<string>, subgold string"
)
RUNS = "run_id string, model string, base_url string, params map<string,string>, created_at timestamp"
METADATA = "struct<parse_source:string,intermediate_correct:boolean,intermediate_parsed:string>"
RESPONSES = (
    "run_id string, item_id string, sample_idx int, raw string, parsed string, correct boolean, confidence int, latency_ms int, "
    f"prompt_tokens int, completion_tokens int, metadata {METADATA}"
)
TELEMETRY = (
    "run_id string, item_id string, sample_idx int, capabilities array<string>, reasoning_token_source string, prompt_tokens int, completion_tokens int, "
    "reasoning_tokens int, reasoning_density_proxy double, ttft_ms int, first_reasoning_ms int, reasoning_wall_ms int, answer_wall_ms int, "
    "token_entropy_mean double, token_entropy_max double, friction_transitions int, logprob_divergence_spikes int, unobservable_fields map<string,string>"
)
#: What an item of a run adds to the metrics that are kept up to date, and what it added before.
FACTS = (
    "run_id string, item_id string, family string, difficulty int, probe string, k int, answered boolean, right boolean, strict_right boolean, "
    "was struct<run_id:string,family:string,difficulty:int,probe:string,k:int,answered:boolean,right:boolean,strict_right:boolean>"
)
#: Columns that tell a stored row from others.
KEYS = {"items": ("item_id",), "runs": ("run_id",), "responses": ("run_id", "item_id", "sample_idx"), "telemetry": ("run_id", "item_id", "sample_idx"), "facts": ("run_id", "item_id")}
SCHEMAS = {"items": ITEMS, "runs": RUNS, "responses": RESPONSES, "telemetry": TELEMETRY, "facts": FACTS}
#: What ``raw`` holds where the call failed; ``correct`` is null there.
ERROR = "__ERROR__"

LOGPROBS = "array<struct<token:string,logprob:double,top_logprobs:array<struct<token:string,logprob:double>>>>"
EVENTS = "array<struct<at:double,type:string,block:string,text:string,input_tokens:int,output_tokens:int,thinking_tokens:int>>"
EVENT_FIELDS = ("at", "type", "block", "text", "input_tokens", "output_tokens", "thinking_tokens")
