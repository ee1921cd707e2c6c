"""Column expressions; no function here starts a job."""
