"""Native column expressions and skew-safe DataFrame helpers."""
