"""Columns the SQL engine widens (128-bit sums, exact decimals), cast back to the types Spark returns."""

BIGINT_COLUMNS = {
    "repeated_calls": "calls repeated",
    "write_match": "matched total wrong unrequested",
    "results_of_calls": "block",
    "task_profile": "successes",
    "profile_merge_add": "successes trials",
    "profile_merge_overwrite": "successes",
    "prior_inheritance": "successes",
    "recent_else_full_prior": "successes",
    "entity_counts": "entities",
    "clean_texts": "chars",
    "length_filter": "kept_tokens",
    "sequence_length_stats": "total",
    "split_check": "rows",
    "episode_write_metrics": "repeated unrequested matched wrong",
    "prefix_consistency": "per_turn",
    "consistency_gate": "turn_pairs tokens_single_sequence tokens_per_turn",
    "training_sequences": "trained position_sum target_sum",
    "sequence_summary": "trained_tokens",
    "episode_store_through_checkpoint": "reward",
    "reward_rule_signal": "failures credited",
    "validation_row": "episodes",
    "decoy_orders": "decoys",
    "request_bundles": "writes",
    "stream_posterior": "wins",
}

DOUBLE_COLUMNS = {
    "stream_posterior": "a b",
}
