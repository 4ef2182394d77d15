"""Operators for preparing training text: near-duplicates, token budgets, answer defects, splitting, packing, mixing, languages."""
