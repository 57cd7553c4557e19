"""Operators for preparing language-model training text.

Nothing outside this folder imports it; the folder can be removed whole.
"""
