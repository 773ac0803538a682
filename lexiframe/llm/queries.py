"""Registered queries of the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

from lexiframe.llm.compact_windows import op4_compact_windows
from lexiframe.llm.filter_audit import ORACLE as FILTER_SQL
from lexiframe.llm.filter_audit import op12_filter_interactions
from lexiframe.llm.html_text import op8_tag_ratio_text
from lexiframe.llm.jaccard_groups import ORACLE as JACCARD_SQL
from lexiframe.llm.jaccard_groups import op6_jaccard_groups
from lexiframe.llm.packing import op7_bin_completion
from lexiframe.llm.robust_rules import op2_robust_rules
from lexiframe.llm.sequence_files import op3_sequence_files
from lexiframe.llm.sharding import op5_jump_shards
from lexiframe.llm.spelling_groups import op13_spelling_forms
from lexiframe.llm.templates import op10_template_leaks
from lexiframe.llm.toxic_sentences import op11_toxic_sentences
from lexiframe.llm.warc_audit import ORACLE as AUDIT_SQL
from lexiframe.llm.warc_audit import op9_merkle_audit
from lexiframe.llm.weak_labels import op1_weak_label_quality

QUERIES = {f.__name__: f for f in (op1_weak_label_quality, op2_robust_rules, op3_sequence_files, op4_compact_windows, op5_jump_shards, op6_jaccard_groups, op7_bin_completion,
                                op8_tag_ratio_text, op9_merkle_audit, op10_template_leaks, op11_toxic_sentences, op12_filter_interactions,
                                op13_spelling_forms)}
ORACLE: dict[str, str] = {"op6_jaccard_groups": JACCARD_SQL, "op9_merkle_audit": AUDIT_SQL, "op12_filter_interactions": FILTER_SQL}
