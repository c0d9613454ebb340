"""Training-data operators: PII, HTML, licences, BPE, language, leaks, WARC, tokens, near copies, quality.

Nothing outside this package imports it.
"""
