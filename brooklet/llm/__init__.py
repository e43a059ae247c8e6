"""Operators for preparing large text corpora: mixing, scoring, deduplication, archives, language, decontamination."""
