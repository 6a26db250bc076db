"""Scoring of streams with fitted tables."""
