"""Operators for language-model text: language labels, answer defects, personal data, packing, leaks, abuse."""
