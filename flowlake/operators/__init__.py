"""Batch operators over flow tables."""
