"""Case triage on Spark: split, score, select, explain, audit, measure, compare."""
