"""Training-data operators: deduplication, filtering, scanning and mixing of
document tables.  Nothing outside this subpackage imports it."""
