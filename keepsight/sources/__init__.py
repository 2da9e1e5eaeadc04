"""Readers and writers for the files a backup fleet leaves behind."""
