"""Readers and writers: parsed pages, text files, chunked index tables."""
