"""Readers and writers: driver tables, YAML configs, versioned item state."""
