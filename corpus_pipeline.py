"""The pipeline's stages and run; they live in tessera.llm.pipeline."""

from tessera.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
