"""Readers, the versioned page table and report sinks."""
