"""The training-data queries by name, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sondage.llm import (
    backoff_lm,
    jaccard_groups,
    license_rules,
    minimax_shards,
    phrase_mining,
    preference_format,
    probminhash,
    pu_quality,
    rule_ledger,
    speculative_bpe,
    template_decontam,
    token_alignment,
    toxicity_lexicon,
)
from sondage.sources import read_table

Query = Callable[[SparkSession, str], DataFrame]


def _over(operator: Callable[..., DataFrame], *tables: str) -> Query:
    return lambda spark, sf_dir: operator(*[read_table(spark, sf_dir, t) for t in tables])


QUERIES: dict[str, Query] = {
    "op1_pu_quality": _over(pu_quality.op1_pu_quality, "documents", "labels"),
    "op2_license_rules": _over(license_rules.op2_license_rules, "documents"),
    "op3_template_decontam": _over(template_decontam.op3_template_decontam, "documents", "benchmark"),
    "op4_toxicity_lexicon": _over(toxicity_lexicon.op4_toxicity_lexicon, "documents", "labels"),
    "op5_minimax_shards": _over(minimax_shards.op5_minimax_shards, "documents"),
    "op6_rule_ledger": _over(rule_ledger.op6_rule_ledger, "documents"),
    "op7_backoff_lm": _over(backoff_lm.op7_backoff_lm, "documents"),
    "op8_preference_format": _over(preference_format.op8_preference_format, "conversations"),
    "op9_speculative_bpe": _over(speculative_bpe.op9_speculative_bpe, "documents"),
    "op10_probminhash": _over(probminhash.op10_probminhash, "documents"),
    "op11_token_alignment": _over(token_alignment.op11_token_alignment, "documents"),
    "op12_phrase_mining": _over(phrase_mining.op12_phrase_mining, "documents"),
    "op13_jaccard_groups": _over(jaccard_groups.op13_jaccard_groups, "documents"),
}

ORACLE_SQL: dict[str, str] = {
    "op7_backoff_lm": backoff_lm.ORACLE, "op8_preference_format": preference_format.ORACLE, "op12_phrase_mining": phrase_mining.ORACLE,
    "op13_jaccard_groups": jaccard_groups.ORACLE,
}
