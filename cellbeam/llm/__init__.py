"""Training-data operators: packing, dedup, quality, toxicity, licences, urls, html, tokens.

Nothing outside this subpackage imports it.
"""
