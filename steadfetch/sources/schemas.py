"""Schemas of the records the stages exchange."""

CANDIDATE = "struct<rank:int,passage_idx:bigint,idx:bigint,text:string,score:double>"

ARTICLE = "article_id bigint, title string, text string"
PASSAGE = "text string"
QUERY = "query_idx bigint, question string, correct_answer string, all_answers array<string>, source string"
QA = "question string, answer array<string>"
TRUTHFUL = "question string, best_answer string, correct_answers array<string>"
PERTURBATION = (
    "query_idx bigint, question string, correct_answer string, all_answers array<string>, "
    "perturbation_type int, wrong_belief string, perturbation_text string, perturbed_query string, shard_id int"
)
NESTED_PERTURBATION = (
    "query_idx bigint, question string, correct_answer string, all_answers array<string>, "
    "perturbations array<struct<perturbation_type:int,perturbation_text:string,perturbed_query:string,"
    "topic:string,wrong_belief:string,t2_variant:string>>"
)
RETRIEVAL = (
    "query_idx bigint, pert_idx int, question string, perturbed_query string, perturbation_type int, "
    f"correct_answer string, all_answers array<string>, candidates array<{CANDIDATE}>"
)
VERDICT = (
    "query_idx bigint, doc_rank bigint, pert_idx int, pert_type int, pred string, judge_raw string, "
    "correct boolean, doc_score double, passage_idx bigint, doc_text_hash string"
)
TRAINING = (
    "query_idx bigint, pert_idx int, question string, document string, robustness_score double, "
    "retriever_score double, doc_rank bigint, train_mode string"
)
GROUP = (
    "key string, question string, train_mode string, "
    "docs array<struct<text:string,score:double,rank:bigint,doc_rank:bigint>>"
)
TOKENIZED = (
    "key string, train_mode string, pos_mask array<boolean>, scores array<float>, input_ids array<array<int>>"
)
