"""Operators for preparing training text: personal data, language, secrets, mixing, near copies, leaks, pages,
vector search, toxicity and URL rules. Nothing outside this subpackage imports it."""
