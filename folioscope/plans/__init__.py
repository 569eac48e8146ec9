"""Registered queries: each operator over the shared tables, with its SQL check."""
