"""References, cells and text as Column expressions, with Python twins where the driver needs them."""
