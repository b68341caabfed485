"""The registered queries: importing this package registers all of them."""

from tidewire.plans import catalogs, corpus, finance, news, trends  # noqa: F401
from tidewire.plans.registry import ORACLES, QUERIES  # noqa: F401
