"""The corpus pipeline: ``STAGES``, ``run`` and ``ORACLE_SQL``, see :mod:`siftwell.llm.stages`."""

from siftwell.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
