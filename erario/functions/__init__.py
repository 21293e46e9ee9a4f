"""Column expressions shared by every plan; no Python UDFs."""
