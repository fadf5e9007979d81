"""Operators with state: bars of a stream, re-delivered items, ask limits."""
