"""Column-expression helpers (JVM-side, codegen-friendly; no Python UDFs)."""
