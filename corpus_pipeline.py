"""The training-text pipeline of the optional text subpackage: its stages, its job and its SQL."""

from rasterloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
