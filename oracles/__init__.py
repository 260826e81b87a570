"""DuckDB oracle SQL used by the correctness gate (not part of the library)."""
