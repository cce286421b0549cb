"""The corpus pipeline: STAGES, ORACLE_SQL and run(). Its code is in recordloom.llm.pipeline."""

from recordloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
