"""Named queries and, where SQL can state them, their oracles."""

from loomdoc.plans import catalogs, conversion, documents, formats, routing, sequences, training

PLANS = [catalogs, conversion, documents, formats, routing, sequences, training]
