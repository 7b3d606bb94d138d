"""Training-data operators: language ID, near-dedup, decontamination, mixing, token output,
licences, toxicity, quality, secrets and exact code search.

Every operator takes and returns DataFrames; nothing outside this subpackage imports it.
"""
