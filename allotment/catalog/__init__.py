from allotment.catalog.registry import ORACLES, QUERIES  # noqa: F401
from allotment.catalog import sampling, plans, designs, estimates, ledgers, diagnostics, results, tables, streams  # noqa: F401
