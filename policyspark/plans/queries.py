"""All queries of the engine itself and their SQL."""

from __future__ import annotations

from policyspark.plans import authored, decisions, structure

QUERIES = {**structure.Q, **decisions.Q, **authored.Q}
ORACLES = {**structure.S, **decisions.S, **authored.S}
