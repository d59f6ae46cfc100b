"""Column-level functions (JVM-side built-in expressions only)."""
