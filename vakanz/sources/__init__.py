"""Readers and writers of the stored stages."""
