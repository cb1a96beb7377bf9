"""Training-data operators: mixing, toxicity, quality rules, HTML extraction, near-dedup,
chat formatting, PII pseudonyms, LM scoring, byte-level BPE and document fingerprints.

Nothing outside this subpackage imports it.
"""
