"""Sources and sinks: trees of files, logical tables, generations and registries."""
