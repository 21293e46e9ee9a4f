"""DataFrame operators the plans are built from."""
