"""Documents to token ids in stages: the driver's names for what is in rillspark.llm.pipeline."""

from rillspark.llm.pipeline import COLUMNS, ORACLE_SQL, STAGES, run

__all__ = ["COLUMNS", "ORACLE_SQL", "STAGES", "run"]
