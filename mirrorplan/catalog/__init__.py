"""Registered queries of the library's own operators, and the SQL that checks them."""

from . import library, lineage, lyrics, outputs, payloads, plan, scalars, states

QUERIES, ORACLES = {}, {}
for _module in (scalars, library, lineage, plan, outputs, lyrics, payloads, states):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
