"""Readers and writers of the archive's tables and bodies."""
