"""All queries of the core."""

from __future__ import annotations

from ranklake.plans.evaluation import EVALUATION
from ranklake.plans.extras import EXTRAS
from ranklake.plans.files import FILES
from ranklake.plans.flagship import HYBRID
from ranklake.plans.heldout import HELDOUT
from ranklake.plans.notices import NOTICES
from ranklake.plans.policies import POLICIES
from ranklake.plans.profiles import PROFILES
from ranklake.plans.records import RECORDS
from ranklake.plans.registry import Registry
from ranklake.plans.retrieval import RETRIEVAL
from ranklake.plans.streams import STREAMS
from ranklake.plans.upkeep import UPKEEP

CORE = Registry()
FLAGSHIP = "hybrid_top"
for part in (RECORDS, NOTICES, RETRIEVAL, EVALUATION, UPKEEP, EXTRAS, HYBRID, PROFILES, HELDOUT, FILES, POLICIES, STREAMS):
    for name, plan in part.plans.items():
        CORE.add(name, part.sql.get(name))(plan)
