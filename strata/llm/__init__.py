"""Training-data operators: URL filters, quality rules, language ID, similarity joins, exact
substring dedup, WARC, licence scans, decontamination, toxicity, packing, language-model scoring and whitening.

Nothing else in the library imports this subpackage.
"""
