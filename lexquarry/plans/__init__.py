"""Session-level helpers: shared storage and lineage cuts."""
