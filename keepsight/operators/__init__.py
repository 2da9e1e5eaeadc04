"""Batch operators over backup-fleet tables."""
