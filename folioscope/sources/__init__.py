"""Readers and sinks: Markdown corpora, event logs, feeds, sessions, derived tables."""
