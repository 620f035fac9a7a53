"""Readers and writers of span files, trace JSON, corpora and result tables."""
