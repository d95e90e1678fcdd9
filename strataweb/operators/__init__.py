"""Relational, document and inference operators over captures."""
