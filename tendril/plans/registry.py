"""Every query by name, and the SQL that checks it."""

from . import flows, inline, tenders, texts

QUERIES: dict = tenders.QUERIES | texts.QUERIES | inline.QUERIES | flows.QUERIES
ORACLES: dict = tenders.ORACLES | texts.ORACLES | inline.ORACLES | flows.ORACLES
