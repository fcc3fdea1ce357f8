"""Functions of terazi."""
