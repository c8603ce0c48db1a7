"""Registry of the analytics queries and of their SQL."""

from __future__ import annotations

from txintel.plans import learning, ledger, network, operations, streams, whole
from txintel.runtime import sized

MODULES = (network, ledger, learning, streams, whole, operations)
#: The table whose rows say how many tasks a module's shuffles have, and rows that each becomes: lines, announcements of orders.
SIZES = {ledger: ("lineitem", 1), whole: ("lineitem", 1), operations: ("orders", 5)}
QUERIES = {name: sized(query, *SIZES[m]) if m in SIZES else query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
