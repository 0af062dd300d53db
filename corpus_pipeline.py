"""The corpus pipeline: STAGES, ORACLE_SQL and run(spark, sf_dir); its body is in the subpackage llm."""

from tidemark.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
