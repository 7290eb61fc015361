"""Column functions: no data moves here, everything stays inside whole-stage code generation."""
