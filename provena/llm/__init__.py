"""Training-data operators: decontamination, extraction, de-duplication, classifiers, tokens, search.

Nothing outside this subpackage imports it; the query registry adds it when it is present.
"""
