"""End-to-end plans composed from operators (prepare, score, validate, train)."""
