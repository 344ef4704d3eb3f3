"""Readers and writers of the files that evaluation runs leave."""
