from worldstate.plans import changes, ownership, planets, scalars, streams, world  # noqa: F401
from worldstate.plans.registry import ORACLES, QUERIES  # noqa: F401
