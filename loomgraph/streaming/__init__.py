"""Edge streams."""
