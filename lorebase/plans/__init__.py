"""Query registry: importing this package registers every query."""

from lorebase.plans import evaluation, governance, maintenance, reports, retrieval, storage  # noqa: F401
from lorebase.plans.registry import REGISTRY  # noqa: F401
