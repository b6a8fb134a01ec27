"""Operators on text corpora and vectors for training data; optional, imported by nothing else."""

from loomdoc.llm import plans_pages, plans_text, plans_vectors

PLANS = [plans_text, plans_pages, plans_vectors]
