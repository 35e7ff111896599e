"""Readers: corpora, rule files, advisory feeds, baselines, scan history."""
