"""Readers and writers around the listing tables."""
