"""Readers, writers and the versioned stores."""
