"""Every query by name, with its SQL where SQL can state it."""

from opswatch.plans import events, feedback, roundtrips, streams, timing, training, vectors

_MODULES = (events, feedback, timing, vectors, training, streams, roundtrips)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
