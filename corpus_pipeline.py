"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, sharding."""

from glossa.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
