"""Plan helpers: lineage cuts, bounded collection and scans over ordered, chunked keys."""
