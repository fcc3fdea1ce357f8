"""Sources of terazi."""
