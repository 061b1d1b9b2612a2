"""Column functions: angles, sphere, mesh, statistics, lens."""
