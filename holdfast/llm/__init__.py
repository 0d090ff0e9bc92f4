"""Operators for preparing training text: language, secrets, URLs, copies, mixing, archives, tokens, toxicity."""
