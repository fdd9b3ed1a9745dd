"""Rules, grids and registered queries."""
