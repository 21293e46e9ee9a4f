"""Plans: the typed model, reports, checks and loads."""
