"""How plans are cut and joined."""
