"""Operators for preparing training text: tokens, chat records, duplicates, quality, fixity, secrets and mixtures."""
