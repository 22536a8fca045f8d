"""The queries of this subpackage."""

from kgspark.llm.decontaminate import OP1_SQL, op1_decontaminate
from kgspark.llm.exact_topk import OP4_SQL, op4_exact_topk
from kgspark.llm.lm_score import op6_lm_score
from kgspark.llm.secret_scan import OP2_SQL, op2_secret_scan
from kgspark.llm.simhash_dedup import op5_simhash_dedup
from kgspark.llm.source_mix import op8_source_mix
from kgspark.llm.substring_dedup import OP3_SQL, op3_substring_dedup
from kgspark.llm.token_counts import op10_token_counts
from kgspark.llm.toxicity import op7_toxicity
from kgspark.llm.url_filter import op9_url_filter

QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_secret_scan, op3_substring_dedup, op4_exact_topk, op5_simhash_dedup, op6_lm_score, op7_toxicity, op8_source_mix, op9_url_filter, op10_token_counts)}

ORACLE_SQL: dict[str, str] = {"op1_decontaminate": OP1_SQL, "op2_secret_scan": OP2_SQL, "op3_substring_dedup": OP3_SQL, "op4_exact_topk": OP4_SQL}
