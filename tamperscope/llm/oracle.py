"""SQL twins of the text queries that SQL can express."""

from __future__ import annotations

from tamperscope.llm import backoff_lm, chat, collocations, license_scan, line_frequency, periodic_runs

ORACLES: dict[str, str] = {
    "op4_license_scan": license_scan.scan_sql(),
    "op5_line_frequency": line_frequency.quality_sql(),
    "op8_chat_rotation": chat.rotate_sql(),
    "op11_backoff_lm": backoff_lm.model_scores_sql(),
    "op12_periodic_runs": periodic_runs.run_digests_sql(),
    "op13_collocations": collocations.collocations_sql(),
}
