"""Readers and the mappers from landed payloads to raw postings."""
