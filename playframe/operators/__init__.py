"""Relational, interval, window and matching operators; every operator takes column names."""
