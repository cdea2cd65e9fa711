"""Plan-level helpers: durable cuts, skew-safe joins, size checks."""
