"""Training-data operators: language ID, toxicity, near-duplicates, packing, token files,
decontamination, URL filters, LM scoring, quality rules and token counts.

Nothing outside this subpackage imports it. ``queries`` holds the registered queries.
"""
