"""Readers, validated ingest and writers."""
