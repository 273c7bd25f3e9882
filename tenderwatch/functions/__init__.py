"""Column -> Column building blocks; everything stays inside code generation."""
