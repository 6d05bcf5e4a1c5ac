"""DataFrame operators: cleaning, conforming, islands, attendance, upsert."""
