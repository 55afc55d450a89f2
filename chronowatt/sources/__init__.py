"""Readers, document parsing, fingerprints, contracts and sinks."""
