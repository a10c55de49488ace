"""Readers, writers and the adapter onto the order-management test tables."""
