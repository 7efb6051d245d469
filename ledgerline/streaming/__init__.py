"""Structured Streaming delivery of the ledger operators."""
