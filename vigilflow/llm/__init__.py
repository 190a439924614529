"""Operators for preparing training data: scoring, scanning, deduplication, decontamination, tokens, archives."""
