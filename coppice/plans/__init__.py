"""Plan helpers: staging, fixpoints, binned range joins, as-of joins."""
