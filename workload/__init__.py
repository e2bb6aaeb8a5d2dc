"""The operators run over the harness tables, each with its SQL counterpart where SQL can say it."""

from workload import access, census, landing, layers, links, payload, text  # noqa: F401
from workload.registry import QUERIES, SQL  # noqa: F401
