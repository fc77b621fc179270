"""Read operations, coverage, lifecycle, integrity and extraction."""
