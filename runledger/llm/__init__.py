"""Training-data operators: decontamination, secrets, search, dedup, language, toxicity, tokens, preferences.

Nothing else in the library imports this package. ``queries`` registers one query per operator.
"""
